"""Queries of sources and sinks: a table is written in a form and read back.  What is
written lies in the scratch folder that the cluster shares."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from quiver.plans.catalog import query, read
from quiver.plans.scratch import scratch_dir
from quiver.plans.session import trap
from quiver.sources import files, system


def place(spark) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT source || ' ' || lang AS line FROM documents")
def io_lines(spark, sf_dir):
    p = place(spark)
    files.write_lines(read(spark, sf_dir, "documents").select(F.concat_ws(" ", "source", "lang").alias("line")), p)
    return files.read_lines(spark, p)


_ROWS = "printf('%-8d%12.2f%-10s', c_custkey, c_acctbal, c_mktsegment)"


@query("SELECT c_custkey::INT c0, round(c_acctbal, 2) c1, c_mktsegment c2 FROM customer")
def io_fixed_text(spark, sf_dir):
    p, cust = place(spark), read(spark, sf_dir, "customer")
    files.write_lines(cust.select(F.format_string("%-8d%12.2f%-10s", "c_custkey", "c_acctbal", "c_mktsegment").alias("line")), p)
    return files.fixed_text(spark, p, "IFS", [8, 12, 10])


def _one_file(spark, rows: list[bytes]) -> str:
    """A file of these bytes; for tables of few rows, as the driver writes it."""
    p = place(spark)
    files.write_bytes(spark, p, b"".join(rows))
    return p


@query("SELECT n_nationkey::INT c0, n_name c2 FROM nation WHERE n_nationkey BETWEEN 2 AND 21")
def io_text_slice(spark, sf_dir):
    """A byte slice of a fixed-width file: whole lines from the second on."""
    rows = sorted(read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())  # 25 rows
    p = _one_file(spark, [f"{k:5d}__{n:<20}\n".encode() for k, n in rows])
    return files.fixed_text(spark, p, "I S", [5, 2, 20], 2 * 28, 20 * 28)


@query("SELECT n_nationkey c0, n_nationkey::BIGINT * 3000000000 c1, n_nationkey / 4 c3, n_name c4 FROM nation")
def io_fixed_binary(spark, sf_dir):
    rows = sorted(read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())  # 25 rows
    kind = np.dtype([("a", "<i4"), ("b", "<i8"), ("c", "S2"), ("d", "<f8"), ("e", "S20")])
    p = _one_file(spark, [np.array([(k, k * 3000000000, b"", k / 4, n.encode().ljust(20))], kind).tobytes() for k, n in rows])
    return files.fixed_binary(spark, p, "ij fS", [4, 8, 2, 8, 20])


@query("SELECT i - 3 AS pos, i * 7 AS v FROM (SELECT unnest(range(3, 1000)) i)")
def io_vector_slice(spark, sf_dir):
    p = _one_file(spark, [(np.arange(1000, dtype="<i8") * 7).tobytes()])
    return files.vector(spark, p, "j", 24)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def io_save_load(spark, sf_dir):
    p = place(spark)
    files.save(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), p)
    return files.load(spark, p)


@query("SELECT k, count(*) n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def io_append(spark, sf_dir):
    p = place(spark)
    files.append(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), p, count=False)
    files.append(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), p)
    return files.load(spark, p).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT 11 size, '68656c6c6f20776f726c64' content")
def io_bytes(spark, sf_dir):
    p = place(spark)
    files.write_bytes(spark, p, b"hello")
    files.append_bytes(spark, p, b" world")
    return files.read_bytes(spark, p).select(F.col("length").cast("int").alias("size"), F.lower(F.hex("content")).alias("content"))


@query("SELECT 'b' name, 1 gone")
def io_names(spark, sf_dir):
    p = place(spark)
    files.write_bytes(spark, f"{p}/a", b"1")
    files.write_bytes(spark, f"{p}/c", b"2")
    files.rename(spark, f"{p}/a", f"{p}/b")
    gone = files.delete(spark, f"{p}/c")
    return spark.createDataFrame([(n, int(gone)) for n in files.list_dir(spark, p)], "name string, gone int")


@query("SELECT * FROM (VALUES ('letter', 'type'), ('letters', 'length'), ('single', 'domain'), ('size', 'length'), ('width', 'length')) v(name, code)")
def io_errors(spark, sf_dir):
    p = _one_file(spark, [b"abcde"])
    done = {
        "letter": trap(files.fixed_text, spark, p, "XY", [4, 5]), "letters": trap(files.fixed_text, spark, p, "IJ", [4, 5, 6]), "single": trap(files.vector, spark, p, "z"),
        "size": trap(files.vector, spark, p, "i"), "width": trap(files.fixed_binary, spark, p, "ij", [4, 4]),
    }
    return spark.createDataFrame([(k, v[1]) for k, v in sorted(done.items())], "name string, code string")


@query("SELECT 'set' name, 'x1' v UNION ALL SELECT 'unset', ''")
def environment(spark, sf_dir):
    system.setenv("QUIVER_QUERY", "x1")
    return spark.createDataFrame([("set", system.getenv("QUIVER_QUERY")), ("unset", system.getenv("QUIVER_NOBODY"))], "name string, v string")
