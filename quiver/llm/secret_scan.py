"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong patterns stand on their own: assignments to secret-like names, access
identifiers, long hex runs.  Weak candidates do not: long mixed-case strings and
endpoint addresses are too common.  They are looked for only in texts that hold
an access identifier, and joined to it by intervals: a part's scope reaches
``reach`` code points around it; scopes and candidates are filed under the cells
of ``reach`` code points they cover, and meet by an equi-join on (row, cell) with
an overlap condition.  A secret candidate is reported when an access identifier's
scope meets it, an endpoint when both an identifier's and a secret's do.

Positions come from the lengths of what lies between matches, in code points,
end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import SPACE, box, materialize, unbox
from quiver.operators.cells import index, let, running

#: Patterns by kind, strong ones first; the order is the order of kinds.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = rf"https?://[^{SPACE}\"'<>]+"
KINDS = ["assign", "access", "hex", "secret", "endpoint"]
REACH = 256
MARK = "[REDACTED]"


def matches(text: Column, pattern: str, rank: int, accept=None) -> Column:
    """array<struct<start, rank, end>> of a pattern's leftmost non-overlapping
    matches; ``accept`` filters them by (match, first group) and still lets a
    refused match use up its text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if accept else found
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def positions(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        reach = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m))
        ends = running(reach, lambda a, x: a + x)
        spans = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end")))
        if accept is None:
            return spans
        good = F.zip_with(spans, F.arrays_zip(found.alias("f"), inner.alias("i")), lambda s, m: F.when(accept(m["f"], m["i"]), s))
        return F.filter(good, lambda s: s.isNotNull())

    return let(found, lambda f: F.when(F.size(f) > 0, positions(f)).otherwise(none))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted spans."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def of_rank(spans: Column, *ranks: int) -> Column:
    return F.filter(spans, lambda s: s["rank"].isin(*ranks))


def cells(start: Column, end: Column, reach: int) -> Column:
    return F.explode(F.sequence(F.floor(start / reach), F.floor((end - 1) / reach)))


def linked(found: DataFrame, reach: int) -> DataFrame:
    """(_uid, extra) of rows whose weak candidates meet their complements."""
    some = found.where(F.size("weak") > 0)
    strong = some.select("_uid", F.explode("base").alias("s")).select("_uid", "s.*")
    weak = some.select("_uid", F.explode("weak").alias("s")).select("_uid", "s.*")

    def scope(parts: DataFrame) -> DataFrame:
        wide = parts.select("_uid", (F.col("start") - reach).alias("lo"), (F.col("end") + reach).alias("hi"))
        return wide.withColumn("cell", cells(F.col("lo"), F.col("hi"), reach)).withColumnRenamed("_uid", "_of").withColumnRenamed("cell", "at")

    def meets(candidates: DataFrame, parts: DataFrame) -> DataFrame:
        left, right = candidates.withColumn("cell", cells(F.col("start"), F.col("end"), reach)), scope(parts)
        on = (F.col("_uid") == F.col("_of")) & (F.col("cell") == F.col("at")) & (F.col("lo") < F.col("end")) & (F.col("start") < F.col("hi"))
        return left.join(right, on, "left_semi").drop("cell").distinct()

    identifiers = strong.where("rank = 1")
    secrets = meets(weak.where("rank = 3"), identifiers)
    every = strong.where("rank in (0, 2)").union(secrets)
    endpoints = meets(meets(weak.where("rank = 4"), identifiers), every)
    return secrets.union(endpoints).groupBy("_uid").agg(F.collect_list(F.struct("start", "rank", "end")).alias("extra"))


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """The ``carry`` columns (doc_id by default) with ``base`` (strong spans) and
    ``spans`` (all spans): arrays of (start, rank, end) sorted by start, then
    kind, rank being the place in ``KINDS``.

    Null text counts as empty.  Spans of different kinds may overlap.  Repeated
    rows are scanned each on its own; ids may be null or repeated, as rows are
    told apart by a number given when the strong spans are written.
    """
    carry = carry or ["doc_id"]
    t = F.coalesce(F.col("__text"), F.lit(""))
    strong = F.concat(
        matches(t, ASSIGN, 0, lambda whole, value: F.length(value) >= 6),
        matches(t, ACCESS, 1),
        matches(t, HEX, 2),
    )
    mixed = lambda m, _: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    weak = F.concat(matches(t, rf"({CANDIDATE})", 3, mixed), matches(t, ENDPOINT, 4))
    weak = F.when(F.size(of_rank(F.col("base"), 1)) > 0, weak).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    rows = docs.select(*carry, F.col(text).alias("__text")).withColumn("base", F.array_sort(strong))
    kept = [*carry, "base", weak.alias("weak"), F.monotonically_increasing_id().alias("_uid")]
    found = materialize(rows.select(*kept))
    extra = linked(found, reach)
    out = found.join(extra, "_uid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return out.select(*carry, "base", spans.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = scan(docs)
    count = lambda r: F.size(of_rank(F.col("base"), r)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced by ``mark``, overlapping
    ones by a single mark; null texts stay null.  Columns keep names and order."""
    boxed = box(docs, text)
    out = scan(boxed, text, boxed.columns)
    tops = running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    out = out.withColumn("__m", F.when(F.size("spans") > 0, let(tops, lambda t: merged(F.col("spans"), t))))
    return unbox(out.withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(cut_out(F.col(text), F.col("__m"), mark))), docs, text)


def merged(spans: Column, tops: Column) -> Column:
    """Spans sorted by start, ``tops`` their running ends, as separate stretches."""
    marked = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(tops, i - 1).alias("before")))
    firsts = F.filter(marked, lambda x: x["before"].isNull() | (x["start"] > x["before"]))
    last = F.get(tops, F.size(tops) - 1)
    return let(firsts, lambda f: F.transform(f, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], last).alias("end"))))


def cut_out(text: Column, m: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each of the stretches ``m``.  A place of a text is found
    from its start, so pieces are cut from about as many parts as each part has."""
    from_, until = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"]), lambda i: F.coalesce(F.get(m, i)["start"], F.length(text))
    n = F.size(m) + 1
    width = F.ceil(F.sqrt(n)).cast("int")

    def part(g: Column) -> Column:
        a, b = g * width, F.least((g + 1) * width, n)
        whole = F.substring(text, from_(a) + 1, until(b - 1) - from_(a))
        return let(whole, lambda w: F.transform(F.sequence(a, b - 1), lambda i: F.substring(w, from_(i) - from_(a) + 1, until(i) - from_(i))))

    return F.array_join(F.flatten(F.transform(index(F.ceil(n / width)), part)), mark)
