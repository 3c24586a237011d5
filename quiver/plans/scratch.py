"""Scratch tables in the folder the cluster shares, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MARKED: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: ``spark.checkpoint.dir`` if the
    session names one; else, on a plain local master, a temporary folder that
    goes with the process; else a folder under the warehouse, which a cluster
    shares.  Each application has its own below it, deleted when its driver ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            if "dir" not in _LOCAL:
                _LOCAL["dir"] = tempfile.mkdtemp(prefix="quiver-")
                atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
            base = "file://" + _LOCAL["dir"]
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    folder = f"{base.rstrip('/')}/quiver/{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        fs, path = _fs(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(folder)
    return folder


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: the
    lineage is cut, a lost executor costs a re-read and no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)
