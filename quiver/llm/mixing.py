"""Mixing sources to target weights by whole blocks.

Each source's words, its documents in a fixed pseudorandom order end to end, are
cut into blocks of ``block`` words.  The target of a source (see :func:`targets`)
is a number of passes over its blocks and a part of one more, whose last block
is cut so that the target is met to the word.  Output shards of ``shard`` slots
draw their source counts from what each source still has to give: a tree halves the
range of shards and draws how the slots of every source fall to either half, from
a seed of that range, so that a task draws its own shards and no table of shards is
held anywhere.  Slot j of a source is block perm(j) of pass j div blocks, perm being a
keyed permutation of the source's block indexes; slots meet blocks, and blocks
the documents they cover, by equi-joins on (source, block).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm._common import SPACE, box, materialize, portions, unbox

#: Hash cells of a source; a source's word positions are sums over cells.
CELLS = 4096
#: Sources whose table of one row each is broadcast.
FEW = 100_000
MASK = (1 << 32) - 1


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; a share stops at ``cap`` times its size and
    the excess is shared again by weight until none is above."""
    total, fixed, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(cap * sizes[i] for i in fixed)
        weight = sum(weights[i] for i in free)
        for i in free:
            out[i] = rest * weights[i] / weight if weight else 0.0
        over = [i for i in free if out[i] > cap * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = cap * sizes[i]
            fixed.add(i)


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1, element by element, or its inverse: a four-round
    Feistel network on the least even number of bits that hold n, walked until inside."""
    x, n, key = (np.asarray(a, np.uint64) for a in (x, n, key))
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 2).astype(float))), 2).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))

    def mixed(b, r, k):
        f = (b + np.uint64(r + 1) * np.uint64(0x9E3779B9) + k) & np.uint64(MASK)
        for _ in range(2):
            f = ((f ^ (f >> np.uint64(16))) * np.uint64(0x45D9F3B)) & np.uint64(MASK)
        return f ^ (f >> np.uint64(16))

    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        for r in range(4):
            if back:
                a, b = b ^ (mixed(a, 3 - r, k) & m), a
            else:
                a, b = b, a ^ (mixed(b, r, k) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def key_of(source: int, epoch: np.ndarray, seed: int) -> np.ndarray:
    return (np.uint64(seed) * np.uint64(0x85EBCA6B) + np.uint64(source) * np.uint64(0xC2B2AE35) + np.asarray(epoch, np.uint64) * np.uint64(0x27D4EB2F)) & np.uint64(MASK)


def draw_slots(size: int, target: float, block: int, source: int, seed: int) -> tuple[int, int]:
    """(slots, words of the last one) that make ``target`` words, rounded: whole
    passes, then blocks of one more in its order; the last block may be short."""
    n, words = -(-size // block), round(target)
    if not n or not words:
        return 0, 0
    passes, rest = divmod(words, size)
    if not rest:
        return passes * n, (size - (n - 1) * block if n == 1 else block)
    tail = size - (n - 1) * block
    # the place of the one short block in this pass
    at = int(permute(np.array([n - 1]), np.array([n]), key_of(source, np.array([passes]), seed), back=True)[0])
    if rest <= at * block:
        k = -(-rest // block)
        return passes * n + k, rest - (k - 1) * block
    if rest <= at * block + tail:
        return passes * n + at + 1, rest - at * block
    k = -(-(rest - tail) // block) + 1
    return passes * n + k, rest - tail - (k - 2) * block


def draw(left: np.ndarray, want: int, rng) -> np.ndarray:
    """How many of each source are among ``want`` slots drawn from ``left``."""
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, want, method="marginals")
    got = np.minimum(rng.multinomial(want, left / left.sum()), left)
    while (lack := want - int(got.sum())) > 0:
        spare = left - got
        got = got + np.minimum(rng.multinomial(lack, spare / spare.sum()), spare)
    return got


def shard_counts(slots: list[int], shard: int, seed: int, low: int = 0, high: int | None = None):
    """(shard, its slots of every source, those of the shards before it) for the
    shards low .. high - 1.  Each range of shards is halved by a draw of its own,
    so any part of them costs only the draws on the way to it."""
    total = sum(slots)
    many = -(-total // shard)
    todo = [(0, many, np.array(slots, np.int64), np.zeros(len(slots), np.int64))] if total else []
    while todo:
        a, b, own, before = todo.pop()
        if b <= low or (high is not None and a >= high):
            continue
        if b - a == 1:
            yield a, own, before
            continue
        mid = (a + b) // 2
        left = draw(own, (mid - a) * shard, np.random.default_rng([seed, a, b]))
        todo.append((mid, b, own - left, before + left))
        todo.append((a, mid, left, before))


def mix(docs: DataFrame, block: int = 1024, shard: int = 4096, cap: float = 3.0, weights: list[float] | None = None, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).  documents: the ``carry`` columns, _uid, _size,
    _source_size, _target.  draws: _uid, shard, slot, epoch, from_word, words: the
    stretch of a document's words that a slot takes, repeats as own rows.

    Words are runs of non-blanks; null and empty texts have none and are never
    drawn.  A null source is a source of its own, last in order.  Sources by code
    point weigh 1, 2, 3, repeating, unless ``weights`` are given.  The order of a
    source's documents follows a hash of id and text, so reruns agree; only rows
    equal in both are interchangeable.  One row per source reaches the driver, nothing else.
    """
    spark, carry = docs.sparkSession, carry or [id_col]
    tie = F.xxhash64(F.col(id_col), F.col(text))
    base = materialize(
        docs.select(*carry, F.col(source_col).alias("_source"), F.col(id_col).alias("_id"), word_count(text).alias("_size"), tie.alias("_tie"), F.monotonically_increasing_id().alias("_uid"))
    )
    sums = sorted(base.groupBy("_source").agg(F.sum("_size").alias("n")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["n"]) for r in sums]
    goal = targets(sizes, weights or [1 + i % 3 for i in range(len(sums))], cap)
    drawn = [draw_slots(s, t, block, i, seed) for i, (s, t) in enumerate(zip(sizes, goal))]
    sources = spark.createDataFrame([(r[0], i, sizes[i], goal[i]) for i, r in enumerate(sums)], "_source string, _no int, _source_size long, _target double")
    if len(sums) <= FEW:
        sources = F.broadcast(sources)  # else a join, which the hottest source skews
    known = base.join(sources, base["_source"].eqNullSafe(sources["_source"])).drop("_source")

    # word positions: rows in (cell, tie) order within a source, from sums of whole cells
    cell = F.pmod("_tie", F.lit(CELLS)).cast("int")
    known = known.withColumn("_cell", cell)
    inside = Window.partitionBy("_no", "_cell").orderBy("_tie", "_id", "_size", "_uid").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = known.groupBy("_no", "_cell").agg(F.sum("_size").alias("n"))
    earlier = Window.partitionBy("_no").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select("_no", "_cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    placed = known.where("_size > 0").withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = placed.join(starts, ["_no", "_cell"]).select("_uid", "_no", (F.col("_base") + F.col("_in")).alias("lo"), "_size")
    cover = placed.select("_uid", "_no", "lo", (F.col("lo") + F.col("_size")).alias("hi"))
    cover = cover.withColumn("blk", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))

    # slots of every shard, each with its place in its source's order of draws
    given, blocks = [d[0] for d in drawn], [-(-s // block) for s in sizes]
    many = -(-sum(given) // shard)
    width = max(1, min(many, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            for w in batch.column("id").to_pylist():
                for s, counts, before in shard_counts(given, shard, seed, w * many // width, (w + 1) * many // width):
                    out = []
                    for i in np.flatnonzero(counts).tolist():
                        n = int(counts[i])
                        j = np.arange(before[i], before[i] + n)
                        epoch = j // blocks[i]
                        b = permute(j % blocks[i], np.full(n, blocks[i]), key_of(i, epoch, seed))
                        words = np.where(j == given[i] - 1, drawn[i][1], block)
                        out.append(pd.DataFrame({"_no": np.int32(i), "blk": b, "shard": s, "slot": np.arange(n), "epoch": epoch, "limit": words}))
                    yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)

    asked = spark.range(0, width, 1, width).mapInArrow(slots, "_no int, blk long, shard long, slot long, epoch long, `limit` long")
    asked = asked.hint("merge")  # it grows with the mix, which Spark cannot tell from the range it comes of
    hit = cover.join(asked, ["_no", "blk"])
    start = F.greatest(F.col("lo"), F.col("blk") * block)
    end = F.least(F.col("hi"), F.col("blk") * block + F.col("limit"))
    draws = hit.select("_uid", "shard", "slot", "epoch", (start - F.col("lo")).alias("from_word"), (end - start).alias("words")).where("words > 0")
    return known.select(*carry, "_uid", "_size", "_source_size", "_target"), draws


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    documents, draws = mix(docs, **options)
    taken = draws.groupBy("_uid").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "_uid", "left").select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: for each pass over a source, a drawn document once
    for every unbroken stretch of its words that was drawn, ``text`` being that
    stretch (the whole text where all words were drawn).  Columns keep names and
    order; documents without words are in no mix."""
    boxed = box(docs, text, id_col, source_col)
    columns = ["_box", text]
    documents, draws = mix(boxed, text=text, id_col=id_col, source_col=source_col, carry=columns, **options)
    order = Window.partitionBy("_uid", "epoch").orderBy("from_word")
    run = F.col("from_word") - F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = draws.withColumn("run", run).groupBy("_uid", "epoch", "run")
    stretches = stretches.agg(F.min("from_word").alias("_from"), F.sum("words").alias("_words")).drop("epoch", "run")
    asked = documents.select(*columns, "_uid", "_size", F.col(text).alias("__text")).join(stretches, "_uid").drop("_uid")
    schema = boxed.select(*columns).schema

    def cut(batches):
        import re

        import pyarrow as pa

        word = re.compile(f"[^{SPACE}]+")
        for batch in portions(batches, "__text"):
            out = []
            for t, a, n, size in zip(*(batch.column(c).to_pylist() for c in ("__text", "_from", "_words", "_size"))):
                if n < size:
                    spans = [m.span() for m in word.finditer(t)][a : a + n]
                    t = t[spans[0][0] : spans[-1][1]]
                out.append(t)
            arrays = [pa.array(out, batch.schema.field(c).type) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return unbox(asked.mapInArrow(cut, schema), docs, text)
