"""Continuous processing on Structured Streaming."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.plans.scratch import scratch_dir
from quiver.plans.session import signal


def timer(spark: SparkSession, seconds: float, fn):
    """``fn(tick)`` every interval: calls never overlap and missed ticks are
    dropped.  The query is the handle; ``stop()`` ends it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").foreachBatch(lambda df, n: fn(n)).start()


def watch(stream: DataFrame, fn):
    """``fn(rows, batch)`` for each batch of new rows of a table stream."""
    return stream.writeStream.foreachBatch(fn).trigger(availableNow=True).start()


def handlers(stream: DataFrame, kind: str, table: dict):
    """Messages sent to the handler of their kind, in batch order."""

    def route(df, n):
        for name, fn in table.items():
            fn(df.where(F.col(kind) == name), n)

    return stream.writeStream.foreachBatch(route).trigger(availableNow=True).start()


def files(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def windows(stream: DataFrame, ts: str, size: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by event-time window, late rows up to ``late`` included."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and sum of each key across batches, kept as state."""

    def step(k, batches, state):
        n, s = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, s = n + len(pdf), s + float(pdf[value].sum())
        state.update((n, s))
        yield pd.DataFrame({key: [k[0]], "n": [n], "s": [s]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, s double", "n long, s double", "update", "NoTimeout")


def answer(stream: DataFrame, kind: str, table: dict, reply):
    """Messages sent to the handler of their kind, which returns a table of replies;
    ``reply(rows, batch)`` gets them.  A kind without a handler gets a ``value`` error."""

    def route(df, n):
        known = [k for k in table]
        for name, fn in table.items():
            reply(fn(df.where(F.col(kind) == name), n), n)
        if not df.where(~F.col(kind).isin(*known)).isEmpty():
            signal("value", kind)

    return stream.writeStream.foreachBatch(route).trigger(availableNow=True).start()


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by session: events of a key no further apart than ``gap``."""
    w = F.session_window(ts, gap)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def barrier(query) -> None:
    """Wait until a query has handled everything that has come."""
    query.processAllAvailable()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything available, batch by batch, as a written table: all rows, or for
    ``complete`` those of the last batch."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    kept: list[str] = []

    def keep(df, n):
        path = f"{base}/rows/{n}"
        df.write.mode("overwrite").parquet(path)
        kept[:] = [path] if mode == "complete" else [*[k for k in kept if k != path], path]

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*kept) if kept else spark.createDataFrame([], stream.schema)
