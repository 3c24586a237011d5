"""Vectors as rows and as blocks, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec_col: str) -> Column:
    """Whether a vector takes part: non-null, not zero, no null or non-finite component."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.when(v.isNull(), False).otherwise(fine), F.lit(False))


def packed(vectors: DataFrame, id_col: str, vec_col: str, *carry: str) -> DataFrame:
    """(id, v, the ``carry`` columns, kind) of rows whose vector is usable; v is its
    components as little-endian doubles, or as floats where the column holds floats."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.where(usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *carry)
    kind = "<f4" if single else "<f8"
    schema = rows.drop("v").schema.add("v", "binary")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column("v")
            blob = lists.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            ends = (np.cumsum(pc.list_value_length(lists).to_numpy()) * int(kind[-1])).tolist()
            parts = [blob[a:b] for a, b in zip([0, *ends], ends)]
            kept = [n for n in batch.schema.names if n != "v"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(parts, pa.binary())], names=[*kept, "v"])

    return rows.mapInArrow(run, schema).withColumn("kind", F.lit(kind))


def matrix(blobs, kind: str) -> np.ndarray:
    """Blobs of one length as the rows of a matrix of doubles."""
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def fitted(x: np.ndarray) -> np.ndarray:
    """Rows under the power of two that brings their largest component to [1/2, 1),
    which is exact and keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = fitted(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the original components."""
    a, b = fitted(a), fitted(b)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
