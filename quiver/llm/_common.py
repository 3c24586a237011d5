"""What the operators share: scratch tables in the cluster's shared folder, the
membership hash of the contracts, and connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.plans.scratch import discard, materialize

#: White space of the word contracts.
SPACE = r"\x20\x09-\x0D"


def portions(batches, column: str, most: int = 4 << 20, rows: int = 4096):
    """Arrow batches cut to at most ``rows`` rows and, but for a single longer
    item, ``most`` bytes of the text or binary ``column``, so that what a worker makes
    of them stays small.  Spark itself bounds the bytes of what it sends."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            b = min(b, a + rows, batch.num_rows)
            yield batch.slice(a, b - a)
            a = b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def box(docs: DataFrame, text: str, *beside: str) -> DataFrame:
    """``text`` and the columns ``beside`` as they are, and every column but the
    text in the struct ``_box``, where no name can clash with an operator's own."""
    inside = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")])
    return docs.select(inside.alias("_box"), text, *[b for b in dict.fromkeys(beside) if b != text])


def unbox(df: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs``, in order, from what became of its :func:`box`."""
    return df.select(*[F.col(text) if c == text else F.col("_box").getField(c).alias(c) for c in docs.columns])


def extend(batch, drop: str, add: dict, take=None):
    """An Arrow batch without column ``drop``, its rows picked by ``take`` if
    given, and the columns ``add`` behind; values carried along stay as they are."""
    import pyarrow as pa

    kept = [c for c in batch.schema.names if c != drop]
    arrays = [batch.column(c) if take is None else batch.column(c).take(pa.array(take, pa.int64())) for c in kept]
    return pa.RecordBatch.from_arrays([*arrays, *add.values()], names=[*kept, *add])


def id_remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(mod)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long), root being the
    smallest node that links reach.

    Parents hook onto the smallest grandparent seen across an edge and pointers
    are halved each round, so rounds grow with the logarithm of the longest
    path.  Each round is joins and ``min`` aggregations only (partial before the
    exchange), its result a written table; nothing but one count reaches the
    driver.  Null ends and self links are ignored; an empty table gives none.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct())
    parents = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("f"))
    )
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("f"), F.col("f").alias("g"))
        grand = materialize(parents.join(up, "f").select("node", "f", "g"))
        discard(parents)
        seen = (
            both.join(grand.select(F.col("node").alias("b"), "g"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("g").alias("m"))
        )
        hooks = grand.join(seen, "node")
        nxt = (
            hooks.select("node", F.least("f", "g", "m").alias("f"))
            .union(hooks.select(F.col("f").alias("node"), F.col("m").alias("f")))
            .groupBy("node")
            .agg(F.min("f").alias("f"))
        )
        was = grand.select("node", F.col("f").alias("was"), "g")
        parents = materialize(nxt.join(was, "node").select("node", "f", (F.col("f") != F.col("was")).alias("moved")))
        discard(grand)
        if parents.where("moved").isEmpty():
            discard(both)
            return parents.select("node", F.col("f").alias("root"))
    raise RuntimeError("components did not settle")
