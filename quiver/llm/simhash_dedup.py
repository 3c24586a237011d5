"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of its shingle hashes.  Texts link
when their fingerprints differ in at most ``radius`` bits.  Equal fingerprints
are one class, so a group of copies of any size is a single row before search.

Search over the distinct fingerprints: the 64 bits are split into partitions
that put correlated bits together; partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = radius + 1, so a pair within the radius agrees within t_i bits
somewhere.  Number of partitions and thresholds come from a dynamic program over
estimated probe and candidate counts (estimated on a bounded sample; they steer
cost, never the result).  Every fingerprint is filed under its value in each
used partition and, for t_i > 0, probes the values within t_i flips.  Rows that
meet are verified by XOR and bit count.  A bucket emits a star per local
component, never its pairs; a bucket above ``BUCKET`` rows is dealt out over
pairs of chunks, so no task holds more than two chunks and no pair is missed.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import connected_components, discard, extend, materialize, portions

BITS = 64
#: Rows of one chunk of a bucket, larger buckets being split; links held before they
#: become components.
BUCKET, PAIRS = 4096, 1 << 20
#: Fingerprints sampled to estimate correlations and candidate counts.
SAMPLE = 2048


def text_fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint; null or wordless text: 0; fewer than
    ``width`` words: the whole sequence is the one shingle."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(42))), dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, carry: list[str], text: str = "text", width: int = 4) -> DataFrame:
    """``carry`` columns, ``_uid`` (unique per row) and ``_fp`` (the fingerprint
    as a signed long)."""
    schema = docs.select(*[F.col(c) for c in carry]).schema.add("_uid", "long").add("_fp", "long")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in portions(batches, "__text"):
            n = batch.num_rows
            fps = np.fromiter((text_fingerprint(t, width) for t in batch.column("__text").to_pylist()), np.uint64, n)
            yield extend(batch, "__text", {"_uid": pa.array(np.arange(at, at + n)), "_fp": pa.array(fps.view(np.int64))})
            at += n

    return docs.select(*carry, F.col(text).alias("__text")).mapInArrow(run, schema)


# ---- planning -------------------------------------------------------------


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal width, each grown from a seed by
    taking the bit that correlates most with the group so far."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for g in range(parts):
        size = BITS // parts + (g < BITS % parts)
        group = [max(left, key=lambda b: corr[b][left].max(initial=0))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: corr[b][group].mean())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def probes(width: int, t: int) -> float:
    """Expected rows a fingerprint emits for threshold ``t``."""
    from math import comb

    return 0.0 if t < 0 else 1 + sum(comb(width, k) / 2 for k in range(1, t + 1))


def plan(sample: np.ndarray, n: int, radius: int, row_cost: float = 40.0) -> list[tuple[int, list[int], int]]:
    """[(mask, bits, threshold)] of the used partitions, of least estimated
    cost.  Cost of a partition: rows it shuffles times ``row_cost`` plus the
    pairs that meet in it, from the share of sampled pairs within the threshold."""
    best, chosen = float("inf"), []
    pairs = n * max(n - 1, 0) / 2
    sample = sample.astype(np.uint64)
    for parts in range(1, radius + 2):
        groups = group_bits(sample, parts) if len(sample) > 1 else [list(range(g, BITS, parts)) for g in range(parts)]
        cost = []
        for g in groups:
            near = np.bitwise_count((sample[:, None] ^ sample[None, :512]) & np.uint64(mask_of(g))) if len(sample) else np.zeros((1, 1))
            share = [0.0] + [max(float((near <= t).mean()), 2.0 ** -len(g)) for t in range(radius + 1)]
            cost.append([0.0 if t < 0 else n * probes(len(g), t) * row_cost + pairs * share[t + 1] for t in range(-1, radius + 1)])
        # dp[s]: least cost with thresholds so far adding up to s, each counted as t + 1
        dp = {0: (0.0, [])}
        for g in range(parts):
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in dp.items():
                for t in range(-1, min(radius, 2) + 1):
                    key = s + t + 1
                    if key <= radius + 1 and (key not in nxt or c + cost[g][t + 1] < nxt[key][0]):
                        nxt[key] = (c + cost[g][t + 1], [*ts, t])
            dp = nxt
        if radius + 1 in dp and dp[radius + 1][0] < best:
            best, ts = dp[radius + 1]
            chosen = [(mask_of(g), g, t) for g, t in zip(groups, ts) if t >= 0]
    return chosen


# ---- search ---------------------------------------------------------------


def bucket_rows(fps: np.ndarray, chosen: list[tuple[int, list[int], int]]):
    """(part, key, fp, probe) arrays: every fingerprint under its own value and
    under each value it probes.  Of a pair that differs inside the partition only
    the side whose lowest differing bit is 0 probes."""
    out = []
    for part, (mask, bits, t) in enumerate(chosen):
        base = fps & np.uint64(mask)
        out.append((part, base, fps, 0))
        for k in range(1, t + 1):
            for flips in combinations(bits, k):
                pick = (fps >> np.uint64(flips[0])) & np.uint64(1) == 0
                out.append((part, base[pick] ^ np.uint64(mask_of(flips)), fps[pick], 1))
    return out


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the pairs (u, v), for 0..n-1."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        np.minimum.at(new, label[u], m)
        np.minimum.at(new, label[v], m)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def star_edges(group: np.ndarray, fps: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group; verified links as (root fp, member fp)."""
    n = len(fps)
    ends, root = np.searchsorted(group, group, side="right"), np.arange(n)
    at, us, vs, held, step = np.arange(n), [], [], 0, 0
    while len(at):
        step += 1
        at = at[at + step < ends[at]]
        ok = (probe[at] + probe[at + step] < 2) & (np.bitwise_count(fps[at] ^ fps[at + step]) <= radius)
        u, v = root[at[ok]], root[at[ok] + step]
        new = u != v  # links inside what is known to be one component go
        us.append(u[new])
        vs.append(v[new])
        held += len(us[-1])
        if held > PAIRS or not len(at):
            root = local_roots(n, np.concatenate(us), np.concatenate(vs))[root]
            us, vs, held = [], [], 0
    moved = np.flatnonzero((root != np.arange(n)) & (fps[root] != fps))
    return fps[root[moved]], fps[moved]


def link_edges(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column ``_fp``) whose components
    are those of all pairs within ``radius`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("_fp")).limit(SAMPLE).toPandas()["_fp"].to_numpy(np.int64).view(np.uint64)
    chosen = plan(sample, n, radius)

    def file(batches):
        for pdf in batches:
            fps = pdf["_fp"].to_numpy(np.int64).view(np.uint64)
            for part, key, fp, probe in bucket_rows(fps, chosen):
                yield pd.DataFrame({"part": np.int32(part), "key": key.view(np.int64), "fp": fp.view(np.int64), "probe": np.int8(probe)}, index=range(len(fp)))

    filed = materialize(distinct.select("_fp").mapInPandas(file, "part int, key long, fp long, probe byte"))
    hot = filed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    hot = hot.select("part", "key", F.ceil(F.col("n") / BUCKET).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # a chunk meets each other chunk in one task, named by the pair in order
    dealt = filed.join(hot, ["part", "key"], "left").select(
        "part", "key", "fp", "probe", mine.alias("mine"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    )
    dealt = dealt.select(
        F.xxhash64("part", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "fp", "probe"
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def verify(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            last = pdf["cell"].iloc[-1] if len(pdf) else None
            if held and len(pdf) and pdf["cell"].iloc[0] == last == held[-1]["cell"].iloc[-1]:
                held.append(pdf)
                continue
            if len(pdf):
                cut = int(np.searchsorted(pdf["cell"].to_numpy(), last))
                whole = pd.concat([*held, pdf.iloc[:cut]])
                held = [pdf.iloc[cut:]]
                yield links(whole)
        if held:
            yield links(pd.concat(held))

    def links(pdf):
        if not len(pdf):
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        a, b = star_edges(pdf["cell"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["probe"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = dealt.repartition(width, "cell").sortWithinPartitions("cell")
    edges = materialize(dealt.mapInPandas(verify, "a long, b long"))
    discard(filed)
    return edges


def classes(prints: DataFrame, radius: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, heads): root of each distinct fingerprint, and of each root the
    smallest (null?, id, _uid) of its rows."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_uid").alias("uid")))
    distinct = materialize(prints.groupBy("_fp").agg(first.alias("rep")))
    roots = connected_components(link_edges(distinct.select("_fp"), radius))
    labelled = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left")
    labelled = materialize(labelled.select("_fp", "rep", F.coalesce("root", "_fp").alias("root")))
    return labelled, labelled.groupBy("root").agg(F.min("rep").alias("head"))


def simhash_dedup(docs: DataFrame, carry: list[str], radius: int = 4, width: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the ``carry`` columns of the row
    with the smallest id (null ids last, the first read among equals).  Rows are
    picked by their numbers, which no two rows share, so no group is hot."""
    prints = materialize(with_fingerprints(docs, carry, text, width))
    _, heads = classes(prints, radius, id_col)
    return prints.join(heads.select(F.col("head.uid").alias("_uid")), "_uid", "left_semi").select(*carry)


def simhash_groups(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Near-duplicate groups of ``docs``: the ``carry`` columns (the id by
    default) with ``fingerprint`` (16 hex digits), ``component_id`` and ``kept``.

    Null and empty texts have fingerprint zero and link like any other.  Repeated
    rows and ids stay separate rows of one group; a null id is larger than any
    other, so ``component_id`` is null only where a group has no id at all.
    Columns of ``docs`` outside ``carry`` are ignored, whatever their names.
    """
    prints = materialize(with_fingerprints(docs, carry or [id_col], text, width))
    labelled, heads = classes(prints, radius, id_col)
    label = materialize(labelled.join(heads, "root").select("_fp", F.col("head.id").alias("component_id"), F.col("head.uid").alias("head_uid")))
    out = prints.join(label, "_fp").withColumn("kept", F.col("_uid") == F.col("head_uid"))
    return out.withColumn("fingerprint", F.lpad(F.lower(F.hex("_fp")), 16, "0")).drop("_fp", "_uid", "head_uid")
