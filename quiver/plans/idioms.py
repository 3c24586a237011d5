"""Compositions of the operators: text clean-up, number representations, dates,
boolean runs, series, finance, classification, matrices, graphs, rounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiver.functions import expr as e
from quiver.functions import text
from quiver.operators import cells as c
from quiver.operators import linalg as la
from quiver.operators import tables as t
from quiver.plans.catalog import BY, BY_TS, _W, cell, doc, event, line, order, part, query, read

# ---- text ------------------------------------------------------------------------

doc("remove_blanks", lambda: F.md5(F.regexp_replace("text", " ", "")), "md5(replace(text, ' ', ''))")
doc("leading_blanks", lambda: F.ltrim(F.concat(F.lit("  "), "source")), "ltrim('  ' || source)")
doc("trailing_blanks", lambda: F.rtrim(F.concat("source", F.lit("  "))), "rtrim(source || '  ')")
doc("centre", lambda: text.pad(12, text.pad(-9, "source")), "lpad(rpad(source, 9, ' '), 12, ' ')")
doc("words_of_line", lambda: F.size(F.split("text", " ")), "len(string_split(text, ' '))::INT")
doc("count_letter", lambda: (F.length("text") - F.length(F.regexp_replace("text", "e", ""))).cast("long"), "(length(text) - length(replace(text, 'e', '')))")
doc("first_line", lambda: F.element_at(F.split("text", "\n"), 1), "string_split(text, chr(10))[1]")
doc("line_count", lambda: F.size(F.split("text", "\n")), "len(string_split(text, chr(10)))::INT")
doc("upper_case", lambda: F.upper("source"), "upper(source)")
doc("reverse_text", lambda: F.md5(F.reverse("text")), "md5(reverse(text))")
doc("digits_only", lambda: F.regexp_replace("source", "[^0-9]", ""), "regexp_replace(source, '[^0-9]', '', 'g')")
doc("change_letters", lambda: F.translate("source", "src", "SRC"), "translate(source, 'src', 'SRC')")
doc("is_palindrome", lambda: (F.col("lang") == F.reverse("lang")).cast("int"), "(lang = reverse(lang))::INT")
doc("quoted", lambda: F.concat(F.lit('"'), F.col("source"), F.lit('"')), "'\"' || source || '\"'")

doc("between_quotes", lambda: text.between_quotes(F.concat(F.lit('a "'), F.col("source"), F.lit('" b "'), F.col("lang"), F.lit('"'))), "[source, lang]")
doc("blank_runs", lambda: F.size(F.regexp_extract_all("text", F.lit("  +"), F.lit(0))).cast("long"), "len(regexp_extract_all(text, '  +'))")
doc("blank_lines", lambda: F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) == "")).cast("long"), "len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = ''))")

# ---- number representation ----------------------------------------------------------

part("binary_text", lambda: F.bin("p_size"), "bin(p_size)")
part("hex_text", lambda: F.lower(F.hex("p_size")), "lower(hex(p_size))")
part("digit_sum", lambda: F.aggregate(F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: a + d.cast("long")), "list_sum([x::BIGINT FOR x IN string_split(p_partkey::VARCHAR, '')])::BIGINT")
part("digits", lambda: F.transform(F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda d: d != ""), lambda d: d.cast("int")), "[x::INT FOR x IN string_split(p_partkey::VARCHAR, '')]")
part("radix_3", lambda: F.conv(F.col("p_size").cast("string"), 10, 3), "to_base(p_size, 3)")
part("bits_set", lambda: F.bit_count("p_partkey"), "bit_count(p_partkey)::INT")
part("scale_digits", lambda: text.number(10, 3, F.col("p_size") / 7), "lpad(printf('%.3f', p_size / 7), 10, ' ')")
part("round_nearest", lambda: F.floor(F.col("p_retailprice") + 0.5).cast("long"), "floor(p_retailprice + 0.5)::BIGINT")
part("round_hundredth", lambda: e.round_down(0.25, "p_retailprice"), "floor(p_retailprice / 0.25) * 0.25")
part("near_zero", lambda: F.when(F.abs(F.col("p_size") - 10) < 3, 0).otherwise(F.col("p_size") - 10), "CASE WHEN abs(p_size - 10) < 3 THEN 0 ELSE p_size - 10 END")
part("sign", lambda: F.signum(F.col("p_size") - 25).cast("int"), "sign(p_size - 25)::INT")

# ---- dates ------------------------------------------------------------------------------

order("date_parts", lambda: F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")), "[year(o_orderdate)::INT, month(o_orderdate)::INT, day(o_orderdate)::INT]")
order("day_of_year", lambda: F.dayofyear("o_orderdate"), "dayofyear(o_orderdate)::INT")
order("week_day", lambda: F.weekday("o_orderdate"), "(isodow(o_orderdate) - 1)::INT")

# ---- boolean runs and partitions ---------------------------------------------------------

FLAG = "(event_type = 'view')::INT"


def flag():
    return (F.col("event_type") == "view").cast("int")


def prior():
    return F.lag(flag(), 1, 0).over(t.ordered(BY, BY_TS))


event("first_of_run", lambda: ((flag() == 1) & (prior() == 0)).cast("int"), f"({FLAG} = 1 AND coalesce(lag({FLAG}) OVER {_W}), 0) = 0)::INT")
event("last_of_run", lambda: ((flag() == 1) & (F.lead(flag(), 1, 0).over(t.ordered(BY, BY_TS)) == 0)).cast("int"), f"({FLAG} = 1 AND coalesce(lead({FLAG}) OVER {_W}), 0) = 0)::INT")
event("smear", lambda: t.scan(F.max, flag(), BY, BY_TS), f"max({FLAG}) OVER {_W} ROWS UNBOUNDED PRECEDING)")
event("invert_after_first", lambda: (1 - t.scan(F.max, flag(), BY, BY_TS)), f"1 - max({FLAG}) OVER {_W} ROWS UNBOUNDED PRECEDING)")
event("running_mean", lambda: t.scan(F.avg, "event_id", BY, BY_TS), f"avg(event_id) OVER {_W} ROWS UNBOUNDED PRECEDING)")
event("count_before", lambda: (t.scan(F.count, "value", BY, BY_TS) - 1), f"count(value) OVER {_W} ROWS UNBOUNDED PRECEDING) - 1")
event("last_seen_value", lambda: F.last(F.when(flag() == 1, F.col("value")), True).over(t.ordered(BY, BY_TS).rowsBetween(Window.unboundedPreceding, 0)), f"last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING)")


@query(f"SELECT user_id, seg, round(sum(value), 4) s, count(*) n FROM (SELECT *, CAST(sum({FLAG}) OVER {_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) seg FROM events) GROUP BY 1, 2")
def partition_sums(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("seg", t.segments(flag() == 1, BY, BY_TS))
    return ev.groupBy("user_id", "seg").agg(e.rounded(F.sum("value"), 4).alias("s"), F.count("*").alias("n"))


@query("SELECT o_custkey, max(o_orderkey) AS \"last\" FROM orders GROUP BY 1")
def last_index(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS occurrence FROM orders")
def occurrences(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


# ---- series, polynomials, finance ----------------------------------------------------------

cell("taylor_exp", lambda v: e.rounded(F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("p")), lambda a, i: F.struct((a["s"] + a["p"] * F.get(F.col(v), 0) / i).alias("s"), (a["p"] * F.get(F.col(v), 0) / i).alias("p")))["s"], 8), "round(exp(v[1]), 8)")
cell("poly_product", lambda v: F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: e.rounded(F.aggregate(F.sequence(F.greatest(k - 31, F.lit(0)), F.least(k, F.lit(31))), F.lit(0.0), lambda s, i: s + F.get(v, i) * F.get(v, 32 + k - i)), 9)), "[round(list_sum([v[i + 1] * v[33 + k - i] FOR i IN range(greatest(k - 31, 0), least(k, 31) + 1)]), 9) FOR k IN range(0, 63)]")
cell("derivative", lambda v: F.transform(c.drop(-1, v), lambda x, i: x * (63 - i)), "[v[i] * (64 - i) FOR i IN range(1, 64)]")
cell("present_value", lambda v: e.rounded(F.aggregate(F.transform(v, lambda x, i: x / F.pow(F.lit(1.05), i)), F.lit(0.0), lambda a, x: a + x), 8), "round(list_sum([v[i] / pow(1.05::DOUBLE, i - 1) FOR i IN range(1, 65)]), 8)")
cell("compound", lambda v: e.rounded(F.aggregate(v, F.lit(1.0), lambda a, x: a * (1 + x / 100)), 10), "round(list_product([1 + x / 100 FOR x IN v]), 10)")
cell("mean_cell", lambda v: e.rounded(F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x) / F.size(v), 9), "round(list_avg(v), 9)")
cell("max_index", lambda v: c.find(v, F.array_max(F.col(v))), "(list_position(v, list_max(v)) - 1)::BIGINT")
cell("sort_cell", lambda v: F.array_sort(v), "list_sort(v)")
cell("cumulative_max", lambda v: c.scan(lambda a, b: F.greatest(a, b), v), "[list_max(v[1:i]) FOR i IN range(1, 65)]")
cell("interlace", lambda v: F.flatten(c.each2(lambda a, b: F.array(a, b), c.take(32, v), c.drop(32, v))), "flatten([[v[i], v[i + 32]] FOR i IN range(1, 33)])")
cell("insert_after", lambda v: F.array_insert(v, 3, F.lit(0.0)), "list_concat(list_concat(v[1:2], [0.0::DOUBLE]), v[3:])")
cell("merge_by_mask", lambda v: F.zip_with(c.take(32, v), c.drop(32, v), lambda a, b: F.when(a > b, a).otherwise(b)), "[greatest(v[i], v[i + 32]) FOR i IN range(1, 33)]")
cell("all_positive", lambda v: F.forall(F.col(v), lambda x: x > -1).cast("int"), "(list_min(v) > -1)::INT")
cell("diagonal", lambda v: F.transform(c.reshape(v, 8, 8), lambda r, i: F.get(r, i)), "[v[(i - 1) * 9 + 1] FOR i IN range(1, 9)]")
cell("upper_triangle", lambda v: F.transform(c.reshape(v, 8, 8), lambda r, i: F.transform(r, lambda x, j: F.when(j >= i, x).otherwise(0.0))), "[[CASE WHEN j >= i THEN v[(i - 1) * 8 + j] ELSE 0.0::DOUBLE END FOR j IN range(1, 9)] FOR i IN range(1, 9)]")
cell("row_sums", lambda v: F.transform(c.reshape(v, 8, 8), lambda r: e.rounded(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), 9)), "[round(list_sum(v[(i - 1) * 8 + 1:i * 8]), 9) FOR i IN range(1, 9)]")
part("multiplication_table", lambda: c.table_of(lambda a, b: a * b, F.sequence(F.lit(1), F.lit(5)), F.sequence(F.lit(1), F.col("p_size"))), "[[(a * b)::INT FOR b IN range(1, p_size + 1)] FOR a IN range(1, 6)]")
part("identity_matrix", lambda: c.table_of(lambda a, b: (a == b).cast("int"), c.index(F.col("p_size") % 4 + 1), c.index(F.col("p_size") % 4 + 1)), "[[(a = b)::INT FOR b IN range(0, p_size % 4 + 1)] FOR a IN range(0, p_size % 4 + 1)]")
part("hilbert", lambda: c.table_of(lambda a, b: e.rounded(1 / (a + b + 1), 9), c.index(F.col("p_size") % 5 + 1), c.index(F.col("p_size") % 5 + 1)), "[[round(1 / (a + b + 1), 9) FOR b IN range(0, p_size % 5 + 1)] FOR a IN range(0, p_size % 5 + 1)]")
cell("symmetric", lambda v: F.forall(F.flatten(c.each2(lambda r, q: F.zip_with(r, q, lambda x, y: x == y), c.reshape(v, 8, 8), c.flip(c.reshape(v, 8, 8)))), lambda ok: ok).cast("int"), "(len(list_filter(range(1, 65), lambda k: v[k] <> v[((k - 1) % 8) * 8 + (k - 1) // 8 + 1])) = 0)::INT")
cell("saddle", lambda v: F.filter(F.transform(v, lambda x, k: F.when((x == F.array_min(F.get(c.reshape(v, 8, 8), F.floor(k / 8).cast("int")))) & (x == F.array_max(F.get(c.flip(c.reshape(v, 8, 8)), k % 8))), k)), lambda k: k.isNotNull()), "list_filter([CASE WHEN v[k] = list_min(v[((k - 1) // 8) * 8 + 1:((k - 1) // 8) * 8 + 8]) AND v[k] = list_max([v[(r - 1) * 8 + (k - 1) % 8 + 1] FOR r IN range(1, 9)]) THEN (k - 1)::INT END FOR k IN range(1, 65)], lambda x: x IS NOT NULL)")
part("pascal", lambda: F.transform(F.sequence(F.lit(0), F.col("p_size") % 12), lambda k: e.choose(F.col("p_size") % 12, k).cast("long")), "[round(gamma(p_size % 12 + 1) / (gamma(k + 1) * gamma(p_size % 12 - k + 1)))::BIGINT FOR k IN range(0, p_size % 12 + 1)]")
part("quadratic_roots", lambda: F.transform(F.array(F.lit(-1), F.lit(1)), lambda s: e.rounded((F.col("p_size") + s * F.sqrt(F.col("p_size") * F.col("p_size") + 4.0)) / 2, 8)), "[round((p_size - sqrt(p_size * p_size + 4)) / 2, 8), round((p_size + sqrt(p_size * p_size + 4)) / 2, 8)]")
part("annuity", lambda: e.rounded(F.lit(0.08) / (1 - F.pow(F.lit(1.08), -F.col("p_size").cast("double"))), 9), "round(0.08::DOUBLE / (1 - pow(1.08::DOUBLE, -p_size)), 9)")
cell("fifo", lambda v: F.transform(c.slide(lambda a, b: b - a, F.concat(F.array(F.lit(0.0)), F.transform(c.scan(lambda a, b: a + b, F.transform(v, F.abs)), lambda x: F.greatest(x - 2, F.lit(0.0))))), lambda x: e.rounded(x, 9) + 0.0), "[round(greatest(list_sum([abs(x) FOR x IN v[1:i]]) - 2, 0) - greatest(coalesce(list_sum([abs(x) FOR x IN v[1:i - 1]]), 0) - 2, 0), 9) + 0.0::DOUBLE FOR i IN range(1, 65)]")
cell("reverse_infixes", lambda v: c.reverse_infixes(v, [10, 50, 4]), "list_concat(list_concat(list_reverse(v[1:10]), list_reverse(v[11:60])), list_reverse(v[61:64]))")
cell("infix_sums", lambda v: F.transform(c.partition_sums(v, F.transform(v, lambda _, i: (i % 16 == 0).cast("int"))), lambda x: e.rounded(x, 9)), "[round(list_sum(v[i * 16 + 1:i * 16 + 16]), 9) FOR i IN range(0, 4)]")
cell("spread_heads", lambda v: c.spread(v, F.array(F.lit(3), F.lit(1)), 5, F.lit(0.0)), "[0.0::DOUBLE, v[2], 0.0::DOUBLE, v[1], 0.0::DOUBLE]")
cell("scattered_index", lambda v: F.array(*[c.path(c.reshape(v, 8, 8), i, j) for i, j in ((0, 7), (3, 3), (7, 0))]), "[v[8], v[28], v[57]]")
cell("raveled_index", lambda v: F.array(F.floor(c.find(v, F.array_max(v)) / 8).cast("long"), c.find(v, F.array_max(v)) % 8), "[((list_position(v, list_max(v)) - 1) // 8)::BIGINT, ((list_position(v, list_max(v)) - 1) % 8)::BIGINT]")
order("twelve_hour", lambda: F.date_format("o_orderdate", "hh:mm a"), "strftime(o_orderdate, '%I:%M %p')")
event("hhmmss", lambda: F.array(F.hour("ts"), F.minute("ts"), F.second("ts")), "[hour(ts)::INT, minute(ts)::INT, second(ts)::INT]")
part("fibonacci", lambda: c.do_fold(20, lambda x: F.struct(x["b"].alias("a"), (x["a"] + x["b"]).alias("b")), F.struct(F.lit(0).cast("long").alias("a"), F.col("p_partkey").alias("b")))["a"], "6765 * p_partkey")

# ---- classification, replacement, sets -------------------------------------------------------

line("class_of_width", lambda: F.floor(F.col("l_quantity") / 7).cast("int"), "floor(l_quantity / 7)::INT")
line("half_open_test", lambda: ((F.col("l_quantity") >= 10) & (F.col("l_quantity") < 20)).cast("int"), "(l_quantity >= 10 AND l_quantity < 20)::INT")
line("choose_by_sign", lambda: F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).when(F.col("l_quantity") < 25, -F.col("l_extendedprice")).otherwise(0.0), "CASE WHEN l_quantity > 25 THEN l_extendedprice WHEN l_quantity < 25 THEN -l_extendedprice ELSE 0.0::DOUBLE END")
line("replace_by_table", lambda: F.element_at(F.create_map(*[F.lit(x) for x in ("A", 1, "N", 2, "R", 3)]), F.col("l_returnflag")), "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END")
line("in_set", lambda: F.col("l_returnflag").isin("A", "R").cast("int"), "(l_returnflag IN ('A', 'R'))::INT")


@query("SELECT width_bucket n, cnt FROM (SELECT least(greatest(floor((o_totalprice - 0) / 60000)::BIGINT + 1, 0), 11) width_bucket, count(*) cnt FROM orders GROUP BY 1)")
def counts_between(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.width_bucket("o_totalprice", F.lit(0.0), F.lit(600000.0), F.lit(10)).alias("n")).agg(F.count("*").alias("cnt"))


@query("SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1 INTERSECT SELECT s_nationkey FROM supplier")
def common_keys(spark, sf_dir):
    a = read(spark, sf_dir, "customer").groupBy("c_nationkey").count().where("count > 1").select("c_nationkey")
    return a.intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY CUBE (1, 2)")
def cube_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT i, round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT vec_id i, unnest(embedding)::DOUBLE v FROM embeddings) GROUP BY 1")
def row_norms(spark, sf_dir):
    x = la.coordinates(read(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"))
    return x.groupBy("i").agg(e.rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"))


_EDGES = "(SELECT n_nationkey a, (n_nationkey * 3 + 1) % 25 b FROM nation)"


@query(f"WITH RECURSIVE e AS {_EDGES}, d(a, b, hops) AS (SELECT a, b, 1 FROM e UNION SELECT d.a, e.b, hops + 1 FROM d JOIN e ON e.a = d.b WHERE hops < 60) SELECT a::INT a, b::INT b, min(hops)::INT hops FROM d GROUP BY 1, 2")
def distances(spark, sf_dir):
    edges = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b"))
    return t.shortest(edges)


@query(f"SELECT user_id, min(n)::BIGINT periods FROM (SELECT user_id, row_number() OVER {_W}) n, round(sum(value) OVER {_W} ROWS UNBOUNDED PRECEDING), 6) s FROM events) WHERE s >= 100 GROUP BY 1")
def payback(spark, sf_dir):
    """Periods until a user's values have paid back 100."""
    w = t.ordered(BY, BY_TS)
    ev = read(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("n"), e.rounded(t.scan(F.sum, "value", BY, BY_TS), 6).alias("s"))
    return ev.where("s >= 100").groupBy("user_id").agg(F.min("n").alias("periods"))


@query(f"SELECT event_id, round(100 * pow(1.05::DOUBLE, row_number() OVER {_W}) % 40), 6) v FROM events")
def future_value(spark, sf_dir):
    n = F.row_number().over(t.ordered(BY, BY_TS))
    return read(spark, sf_dir, "events").select("event_id", e.rounded(100 * F.pow(F.lit(1.05), n % 40), 6).alias("v"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) k FROM events")
def props_value(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# ---- the text front-end ---------------------------------------------------------------------


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) s, max(l_quantity) m FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
def notation_fold(spark, sf_dir):
    from quiver.plans import notation

    got = notation.fold(read(spark, sf_dir, "lineitem"), ["l_returnflag"], where="l_quantity>30", s="+/l_extendedprice*1-l_discount", m="|/l_quantity")
    return got.select("l_returnflag", e.rounded("s", 2).alias("s"), "m")


@query("SELECT p_partkey, 2 * (p_size + 1) a, (p_size > 10)::INT b, p_retailprice / p_size c FROM part")
def notation_select(spark, sf_dir):
    from quiver.plans import notation

    return notation.select(read(spark, sf_dir, "part"), p_partkey="p_partkey", a="2*p_size+1", b="p_size>10", c="p_retailprice%p_size")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 < 0 THEN o_custkey % 7 + 7 ELSE o_custkey % 7 END r, greatest(o_orderkey, o_custkey) g FROM orders")
def notation_modulo(spark, sf_dir):
    from quiver.plans import notation

    return notation.select(read(spark, sf_dir, "orders"), o_orderkey="o_orderkey", r="o_custkey!7", g="o_orderkey|o_custkey")
