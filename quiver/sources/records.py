"""Packed records as a Python data source: files are read by byte ranges that end on
record boundaries, so one large file is many tasks."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a task's range, and of what it holds at once.
RANGE, CHUNK = 64 << 20, 4 << 20
#: Numpy formats of the letters of binary records.
NUMPY = {"b": "i1", "s": "<i2", "i": "<i4", "j": "<i8", "e": "<f4", "f": "<f8"}


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int, first: int):
        self.uri, self.start, self.end, self.first = uri, start, end, first


class Records(DataSource):
    """Options: ``files`` (JSON list of [uri, start, end]), ``types`` and ``widths``
    (JSON) of the fields, ``positions`` for a leading column with the record's number."""

    @classmethod
    def name(cls) -> str:
        return "quiver_records"

    def schema(self) -> str:
        return self.options["schema_"]

    def reader(self, schema) -> "Reader":
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.files, self.types = json.loads(options["files"]), options["types"]
        self.widths = json.loads(options["widths"])
        self.range = int(options.get("range", RANGE))
        self.size, self.positions = sum(self.widths), options.get("positions") == "true"

    def partitions(self):
        out, first, step = [], 0, max(1, self.range // self.size) * self.size
        for uri, start, end in self.files:
            for a in range(start, end, step):
                b = min(end, a + step)
                out.append(Range(uri, a, b, first))
                first += (b - a) // self.size
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        if part.end <= part.start:
            return
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(part.uri)
        with fs.open_input_file(path) as f:
            step = max(1, CHUNK // self.size) * self.size
            for a in range(part.start, part.end, step):
                blob = f.read_at(min(step, part.end - a), a)
                yield parse(blob, self.types, self.widths, part.first + (a - part.start) // self.size if self.positions else None)


def parse(blob: bytes, types: str, widths: list[int], first: int | None = None):
    """Records as an Arrow batch, a leading column numbering them from ``first``."""
    import pyarrow as pa

    names = [f"c{i}" for i in range(len(types))]
    rec = np.frombuffer(blob, np.dtype({"names": names, "formats": [NUMPY.get(t, f"S{w}") for t, w in zip(types, widths)]}))
    out = {} if first is None else {"pos": pa.array(np.arange(first, first + len(rec)))}
    for name, t in zip(names, types):
        if t in NUMPY:
            v = np.ascontiguousarray(rec[name])
            out[name] = pa.array(v.astype("i4") if t in "bs" else v)
        elif t != " ":
            out[name] = pa.array([x.decode("latin-1").rstrip("\0 " if t == "S" else "\0") for x in rec[name].tolist()], pa.string())
    return pa.RecordBatch.from_pydict(out)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of a file, or of the files of a folder or pattern, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(p) or []:
        inside = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(str(x.getPath().toString()), x.getLen()) for x in inside if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted((u.replace("file:/", "file:///", 1) if u.startswith("file:/") and not u.startswith("file:///") else u.replace("s3a://", "s3://", 1), n) for u, n in found)


def table(spark: SparkSession, files: list, types: str, widths: list[int], schema: str, positions: bool = False, range_bytes: int | None = None):
    """DataFrame of the records in byte ranges (uri, start, end) of whole records."""
    spark.dataSource.register(Records)
    reader = spark.read.format("quiver_records").option("files", json.dumps(files)).option("types", types).option("widths", json.dumps(widths))
    return reader.option("schema_", schema).option("positions", str(positions).lower()).option("range", str(range_bytes or RANGE)).load()
