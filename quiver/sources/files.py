"""Readers and writers.  Text is read by Spark; packed records and byte slices by
ranges of whole records, whatever the size of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.plans.session import signal
from quiver.sources import records
from quiver.sources.records import NUMPY

#: Letters of fixed-width text and of packed binary records.
TEXT_TYPES = {"I": "int", "J": "bigint", "E": "float", "F": "double", "C": "string", "S": "string"}
BINARY_TYPES = {"c": ("string", 1), "b": ("int", 1), "s": ("int", 2), "i": ("int", 4), "j": ("bigint", 8), "e": ("float", 4), "f": ("double", 8), "C": ("string", 0), "S": ("string", 0)}
#: How missing and infinite numbers are spelt in text.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def show_lines(df: DataFrame, column: str = "line", most: int = 1000) -> None:
    """The first lines on the console, as the driver prints them."""
    for r in df.select(F.col(column).cast("string").alias("line")).limit(most).toLocalIterator():
        print(r["line"])


def check_schema(types: str, widths: list[int], known) -> None:
    if any(t != " " and t not in known for t in types):
        signal("type", types)
    if len(types) != len(widths):
        signal("length", f"{len(types)} types, {len(widths)} widths")


def text_value(raw: Column, letter: str) -> Column:
    """A text field as its type: numbers that do not parse are null, ``0n`` is NaN,
    and ``0I`` and ``0i`` are infinities."""
    kind, t = TEXT_TYPES[letter], F.trim(raw)
    if letter == "C":
        return raw
    if letter == "S":
        return t
    if letter in "IJ":
        most = 2**31 - 1 if letter == "I" else 2**63 - 1
        return F.when(t == "0I", F.lit(most)).when(t == "-0I", F.lit(-most)).when(t.rlike("^[+-]?[0-9]+$"), t.try_cast(kind)).cast(kind)
    inf = F.when(t == "0n", F.lit(float("nan"))).when(t == "0i", F.lit(float("inf"))).when(t == "-0i", F.lit(-float("inf")))
    return inf.when(t.rlike(NUMBER), t.try_cast(kind)).cast(kind)


def fixed_text(spark: SparkSession, path: str, types: str, widths: list[int], offset: int | None = None, length: int | None = None) -> DataFrame:
    """Fixed-width text: one letter and width per field, a blank skips.  Numbers
    that do not parse are null; a line of another length is a length error.  With
    an offset or a length only those bytes are read, in ranges of whole lines."""
    check_schema(types, widths, TEXT_TYPES)
    if offset is not None or length is not None:
        lines = line_slice(spark, path, sum(widths), offset or 0, length)
    else:
        lines = read_lines(spark, path)
    fine = F.length("line") == sum(widths)
    at, fields = 1, []
    for n, (t, w) in enumerate(zip(types, widths)):
        if t != " ":
            fields.append(F.when(fine, text_value(F.substring("line", at, w), t)).otherwise(F.raise_error(F.lit("length"))).alias(f"c{n}"))
        at += w
    return lines.select(*fields)


def line_slice(spark: SparkSession, path: str, width: int, offset: int, length: int | None) -> DataFrame:
    """Lines of ``width`` bytes from a byte slice; what parts them is seen at the end of
    the first one."""
    end = min(x for x in (_size(spark, path), None if length is None else offset + length) if x is not None)
    mark = 2 if read_slice(spark, path, offset + width, 1) == b"\r" else 1
    whole = (end - offset) // (width + mark) * (width + mark)
    uri = records.listed(spark, path)[0][0]
    got = records.table(spark, [[uri, offset, offset + whole]], "CC", [width, mark], "pos long, c0 string, c1 string", positions=True)
    bad = ~F.col("c1").isin("\n", "\r\n")
    line = F.rpad(F.col("c0"), width, " ")
    lines = got.select(F.when(bad, F.raise_error(F.lit("length"))).otherwise(line).alias("line"))
    rest = read_slice(spark, path, offset + whole, end - offset - whole).rstrip(b"\r\n")  # a last line without its mark
    return lines.union(spark.createDataFrame([(rest.decode("latin-1"),)], "line string")) if rest else lines


def fixed_binary(spark: SparkSession, path: str, types: str, widths: list[int], offset: int = 0, length: int | None = None) -> DataFrame:
    """Packed little-endian records, of a file, folder or pattern, or of a byte slice
    of a file.  Numeric widths must be exact and what is read a whole number of
    records.  Files are read by ranges of whole records."""
    check_schema(types, widths, BINARY_TYPES)
    for t, w in zip(types, widths):
        if t in NUMPY and w != BINARY_TYPES[t][1]:
            signal("length", f"{t} is {BINARY_TYPES[t][1]} bytes")
    named = [(f"c{i}", BINARY_TYPES[t][0]) for i, t in enumerate(types) if t != " "]
    return records.table(spark, _ranges(spark, path, sum(widths), offset, length), types, widths, ", ".join(f"{n} {k}" for n, k in named))


def _ranges(spark: SparkSession, path: str, size: int, offset: int, length: int | None) -> list:
    found = []
    for uri, n in records.listed(spark, path):
        end = n if length is None else min(n, offset + length)
        if (end - offset) % size:
            signal("length", f"{end - offset} bytes are no whole number of {size}-byte records")
        found.append([uri, offset, end])
    return found


def vector(spark: SparkSession, path: str, letter: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """(pos, v) of a raw typed vector, or of a byte slice of it."""
    if letter not in "cijef":
        signal("domain", letter)
    width = BINARY_TYPES[letter][1]
    got = records.table(spark, _ranges(spark, path, width, offset, length), letter, [width], f"pos long, c0 {BINARY_TYPES[letter][0]}", positions=True)
    return got.select("pos", F.col("c0").alias("v"))


def _size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getLen()


def read_slice(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """A short byte slice of a file, on the driver."""
    fs, p = _fs(spark, path)
    n = max(0, min(length, fs.getFileStatus(p).getLen() - offset))
    if not n:
        return b""
    stream = fs.open(p)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> int:
    """A file of these bytes; how many they are."""
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(data))
    stream.close()
    return len(data)


def append_bytes(spark: SparkSession, path: str, data: bytes) -> int:
    """Bytes behind those of a file, which is made where there is none; its new size.
    Where the file system cannot append, the file is written anew."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return write_bytes(spark, path, data)
    try:
        stream = fs.append(p)
    except Exception:  # noqa: BLE001  not every file system appends
        return write_bytes(spark, path, read_slice(spark, path, 0, _size(spark, path)) + data)
    stream.write(bytearray(data))
    stream.close()
    return _size(spark, path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(df: DataFrame, path: str, count: bool = True) -> int | None:
    """Append rows of the same types; the new row count, from the footers of the
    files, if asked for."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p) and [f.dataType for f in spark.read.parquet(path).schema] != [f.dataType for f in df.schema]:
        signal("type", path)
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() if count else None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_dir(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _fs(spark, old)
    return fs.rename(p, _fs(spark, new)[1])
