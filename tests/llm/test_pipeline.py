"""Each stage on the rows its predecessor kept, against what it must do."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quiver.llm._common import materialize
from quiver.llm.mixing import targets
from quiver.llm.secret_scan import report
from quiver.llm.simhash_dedup import text_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid int, text_size int, lang_pred string"


def words(t):
    return len((t or "").encode().split())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    first, second = kept["language_id"], kept["simhash_dedup"]
    assert len(first) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # all have a language
    fps = np.array([text_fingerprint(t) for t in second.text], np.uint64)
    for i in range(len(fps)):
        assert (np.bitwise_count(np.delete(fps, i) ^ fps[i]) > 4).all()
    every = np.array([text_fingerprint(t) for t in first.text], np.uint64)
    reached = np.array([(np.bitwise_count(fps ^ f) <= 4).any() for f in every])
    assert reached.mean() > 0.95
    clean = spark.createDataFrame(kept["secret_scan"][["doc_id", "text"]])
    assert report(clean).where("n_hex + n_access > 0").isEmpty() and len(kept["secret_scan"]) == len(second)
    mixed, before = kept["mixing"], kept["secret_scan"]
    size = before.assign(n=before.text.map(words)).groupby("source").n.sum().sort_index()
    took = mixed.assign(n=mixed.text.map(words)).groupby("source").n.sum().reindex(size.index, fill_value=0)
    assert (abs(took - targets(size.tolist(), [1 + i % 3 for i in range(len(size))])) <= 1).all()
    packed = kept["packing"]
    assert packed.row_id.nunique() == len(mixed) and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert (packed.groupby("row_id").length.sum() == packed.groupby("row_id").doc_tokens.first()).all()


def test_odd_rows_and_empty_tables(spark, sf_dir):
    rows = [
        (1, None, None, None, None, 1, 2, "x"), (2, "", "en", "a", 0, 1, 2, "x"), (3, "Hello there my friend of old", "en", None, 28, 1, 2, "x"),
        (None, "Hallo mein guter alter Freund hier", "de", "a", 34, 1, 2, "x"), (3, "Hello there my friend of old", "en", None, 28, 1, 2, "x"), (5, "??? 123", "en", "a", 7, 1, 2, "x"),
    ]
    for data, left in ((rows, 2), ([], 0)):
        docs = spark.createDataFrame(data, SCHEMA)
        for n, (_, stage) in enumerate(cp.STAGES):
            out = materialize(stage(spark, docs, sf_dir))
            if n < 4:
                assert out.columns == docs.columns
            if n == 1:
                assert out.count() == left and out.where(F.col("text_size") != 2).isEmpty()
            docs = out
        assert docs.count() >= left
