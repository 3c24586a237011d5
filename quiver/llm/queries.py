"""The registered queries of this folder: ``opN_<name>`` over whole tables, and
DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm._common import table
from quiver.llm.secret_scan import ACCESS, ASSIGN, CANDIDATE, ENDPOINT, HEX, REACH


_USABLE = """SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

OP3_SQL = f"""
WITH RECURSIVE u AS ({_USABLE}),
links AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) m FROM reach GROUP BY a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = e.vec_id) AS BIGINT) n_links, m AS component_id, m = e.vec_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id"""

OP10_SQL = f"""
WITH u AS ({_USABLE}),
d AS (SELECT q.vec_id query_id, c.vec_id,
        sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) score FROM u q JOIN u c
      ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS "rank", vec_id, score FROM d)
SELECT * FROM r WHERE "rank" <= 10"""


def _spans(kind: str, pattern: str, value: int, extra: str = "true") -> str:
    """SQL list of (s, k, e, v) of a pattern's matches in ``t``, v being group ``value``."""
    found, group = f"regexp_extract_all(t, $${pattern}$$, 0)", f"regexp_extract_all(t, $${pattern}$$, {value})"
    before = f"len(list_aggregate(list_prepend('', list_concat(string_split_regex(t, $${pattern}$$)[1:i], {found}[1:i - 1])), 'string_agg', ''))"
    item = f"{{'s': {before}, 'k': {kind}, 'e': {before} + len({found}[i]), 'v': {group}[i]}}"
    return f"list_filter(list_transform(range(1, len({found}) + 1), lambda i: {item}), lambda x: {extra})"


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
b AS (SELECT doc_id, t, {_spans("0", ASSIGN, 1, "len(x.v) >= 6")} a, {_spans("1", ACCESS, 0)} ac, {_spans("2", HEX, 0)} h FROM d),
w AS (SELECT *, list_sort(list_concat(list_concat(a, ac), h)) base,
  CASE WHEN len(ac) > 0 THEN {_spans("3", CANDIDATE, 0, "regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]')")} ELSE [] END c,
  CASE WHEN len(ac) > 0 THEN {_spans("4", ENDPOINT, 0)} ELSE [] END ep FROM b),
l AS (SELECT *, list_filter(c, lambda x: len(list_filter(ac, lambda y: y.s - {REACH} < x.e AND x.s < y.e + {REACH})) > 0) c2 FROM w),
m AS (SELECT *, list_filter(ep, lambda x: len(list_filter(ac, lambda y: y.s - {REACH} < x.e AND x.s < y.e + {REACH})) > 0
  AND len(list_filter(list_concat(list_concat(a, h), c2), lambda y: y.s - {REACH} < x.e AND x.s < y.e + {REACH})) > 0) e2 FROM l),
j AS (SELECT doc_id, a, ac, h, base, list_sort(list_concat(list_concat(base, c2), e2)) al FROM m),
f AS (SELECT doc_id, a, ac, h,
  array_to_string(list_transform(base, lambda x: (['assign','access','hex','secret','endpoint'])[x.k + 1] || ':' || x.s || ':' || x.e), ',') bj,
  array_to_string(list_transform(al, lambda x: (['assign','access','hex','secret','endpoint'])[x.k + 1] || ':' || x.s || ':' || x.e), ',') aj FROM j)
SELECT doc_id, CAST(len(a) AS BIGINT) n_assign, CAST(len(ac) AS BIGINT) n_access, CAST(len(h) AS BIGINT) n_hex, sha256(bj) base_sha256, aj spans FROM f"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.secret_scan import report

    return report(table(spark, sf_dir, "documents"))


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.metric_join import similarity_join

    return similarity_join(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.simhash_dedup import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiver.llm.nearest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, "vec_id % 100 = 0")


def queries() -> dict:
    found = (
        op1_language_id, op2_secret_scan, op3_metric_join, op4_packing, op5_toxicity, op6_lm_scoring, op7_html_extraction,
        op8_mixing, op9_simhash_dedup, op10_nearest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": OP2_SQL, "op3_metric_join": OP3_SQL, "op10_nearest": OP10_SQL}
