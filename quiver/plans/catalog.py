"""Every query of the library's own operators, each with the SQL that checks it.

A query is registered under its function's name by ``@query(sql)``; without SQL
only its rows are checked here, and tests hold it against known results.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiver.functions import codec, dates, draws, numtheory as nt, text
from quiver.functions import expr as e
from quiver.operators import cells as c
from quiver.operators import linalg as la
from quiver.operators import tables as t

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simple(name: str, table: str, columns: dict, sql: str, where: str | None = None):
    """Register a projection: ``columns`` maps names to zero-argument builders."""

    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        return (df.where(where) if where else df).select(*[b().alias(n) for n, b in columns.items()])

    run.__name__ = name
    query(f"SELECT {sql} FROM {table}" + (f" WHERE {where}" if where else ""))(run)


def line(name, build, sql, out="v"):
    simple(name, "lineitem", {"l_orderkey": lambda: F.col("l_orderkey"), out: build}, f"l_orderkey, {sql} AS {out}")


def order(name, build, sql, out="v"):
    simple(name, "orders", {"o_orderkey": lambda: F.col("o_orderkey"), out: build}, f"o_orderkey, {sql} AS {out}")


def part(name, build, sql, out="v"):
    simple(name, "part", {"p_partkey": lambda: F.col("p_partkey"), out: build}, f"p_partkey, {sql} AS {out}")


# ---- arithmetic and predicates ---------------------------------------------------

price, qty, disc, tax = "l_extendedprice", "l_quantity", "l_discount", "l_tax"
line("arith_plus", lambda: F.col(price) + F.col(tax), "l_extendedprice + l_tax")
line("arith_minus", lambda: F.col(price) - F.col(qty), "l_extendedprice - l_quantity")
line("arith_times", lambda: e.rounded(F.col(price) * (1 - F.col(disc)), 4), "round(l_extendedprice * (1 - l_discount), 4)")
line("arith_divide", lambda: e.divide(price, F.col(disc)), "l_extendedprice / l_discount")
line("reciprocal", lambda: e.reciprocal(tax), "1 / l_tax")
line("negate", lambda: -F.col(price), "-l_extendedprice")
line("min_and", lambda: e.minimum(qty, F.lit(25.0)), "least(l_quantity, 25.0::DOUBLE)")
line("max_or", lambda: e.maximum(qty, F.lit(25.0)), "greatest(l_quantity, 25.0::DOUBLE)")
line("less", lambda: e.less(disc, tax), "(l_discount < l_tax)::INT")
line("greater", lambda: e.more(disc, tax), "(l_discount > l_tax)::INT")
line("equal", lambda: e.equal("l_returnflag", F.lit("R")), "(l_returnflag = 'R')::INT")
line("match", lambda: e.match(disc, tax), "(l_discount IS NOT DISTINCT FROM l_tax)::INT")
line("not_mask", lambda: e.not_(tax), "(l_tax = 0)::INT")
line("floor", lambda: e.floor(price), "floor(l_extendedprice)::BIGINT")
line("round_to_multiple", lambda: e.round_down(0.5, qty), "floor(l_quantity / 0.5) * 0.5")
line("round_half_even", lambda: e.round_even(10.0, qty), "10.0::DOUBLE * round_even(l_quantity / 10.0, 0)")
line("conditional", lambda: e.cond(F.col(qty) > 40, F.lit("high"), F.col(qty) > 20, F.lit("mid"), F.lit("low")), "CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END")
order("mod_floored", lambda: e.modulo(F.col("o_orderkey"), F.lit(-7).cast("bigint")), "CASE WHEN o_orderkey % -7 <> 0 AND o_orderkey % -7 > 0 THEN o_orderkey % -7 - 7 ELSE o_orderkey % -7 END")
order("int_div", lambda: e.int_divide(F.col("o_custkey") - 500, F.col("o_orderkey") % 3), "CASE WHEN o_orderkey % 3 <> 0 THEN ((o_custkey - 500) // (o_orderkey % 3))::BIGINT WHEN o_custkey > 500 THEN 9223372036854775807 WHEN o_custkey < 500 THEN -9223372036854775807 END")
order("bit_and", lambda: F.col("o_orderkey").bitwiseAND(F.col("o_custkey")), "o_orderkey & o_custkey")
order("bit_or", lambda: F.col("o_orderkey").bitwiseOR(F.col("o_custkey")), "o_orderkey | o_custkey")
order("bit_xor", lambda: F.col("o_orderkey").bitwiseXOR(F.col("o_custkey")), "xor(o_orderkey, o_custkey)")
order("bit_not", lambda: F.bitwise_not("o_orderkey"), "~o_orderkey")
order("shift_left", lambda: e.shift("o_orderkey", 3), "o_orderkey << 3")
order("shift_right", lambda: e.shift("o_orderkey", -3), "o_orderkey >> 3")
order("rotate_bits", lambda: e.rotate_bits("o_orderkey", 60), "CASE WHEN o_orderkey % 16 >= 8 THEN (o_orderkey % 16 - 16) * 1152921504606846976 ELSE o_orderkey % 16 * 1152921504606846976 END + (o_orderkey // 16)::BIGINT")
order("shift_int", lambda: e.shift("o_orderkey", 29, 32), "CASE WHEN o_orderkey % 8 >= 4 THEN ((o_orderkey % 8 - 8) * 536870912)::INT ELSE (o_orderkey % 8 * 536870912)::INT END")
order("rotate_int", lambda: e.rotate_bits("o_orderkey", 29, 32), "(CASE WHEN o_orderkey % 8 >= 4 THEN (o_orderkey % 8 - 8) * 536870912 ELSE o_orderkey % 8 * 536870912 END + o_orderkey // 8)::INT")
order("power", lambda: e.rounded(e.power(F.col("o_totalprice"), F.lit(0.5)), 6), "round(pow(o_totalprice, 0.5), 6)")
part("choose", lambda: e.rounded(e.choose(F.col("p_size"), F.lit(2)), 4), "round(p_size * (p_size - 1) / 2.0::DOUBLE, 4)")
part("math_log", lambda: e.rounded(e.log("p_retailprice"), 9), "round(ln(p_retailprice), 9)")
part("math_exp", lambda: e.rounded(F.exp(F.col("p_size") / 100), 9), "round(exp(p_size / 100), 9)")
part("math_sqrt", lambda: e.rounded(F.sqrt("p_retailprice"), 9), "round(sqrt(p_retailprice), 9)")
part("math_sqr", lambda: F.col("p_size").cast("double") * F.col("p_size"), "p_size::DOUBLE * p_size")
part("math_abs", lambda: F.abs(F.col("p_size") - 25), "abs(p_size - 25)")
part("math_ceil", lambda: F.ceil("p_retailprice").cast("double"), "ceil(p_retailprice)")
part("math_trunc", lambda: e.trunc(F.col("p_retailprice") - 1500), "trunc(p_retailprice - 1500)")
part("math_rint", lambda: F.rint(F.col("p_size") / 2), "round_even(p_size / 2, 0)")
for fn in ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh"):
    part(f"math_{fn}", lambda fn=fn: e.rounded(getattr(F, fn)(F.col("p_size") / 10), 8), f"round({fn}(p_size / 10), 8)")
for fn in ("asin", "acos"):
    part(f"math_{fn}", lambda fn=fn: e.rounded(getattr(F, fn)(F.col("p_size") / 100), 9), f"round({fn}(p_size / 100), 9)")
part("math_atan2", lambda: e.rounded(F.atan2(F.col("p_size").cast("double"), F.col("p_retailprice")), 9), "round(atan2(p_size, p_retailprice), 9)")
part("math_hypot", lambda: e.rounded(F.hypot(F.col("p_size").cast("double"), F.col("p_retailprice")), 7), "round(sqrt(p_size::DOUBLE * p_size + p_retailprice * p_retailprice), 7)")
part("math_gamma", lambda: e.rounded(e.gamma(F.col("p_size") / 10 + 0.05), 8), "round(gamma(p_size / 10 + 0.05::DOUBLE), 8)")
part("math_lgamma", lambda: e.rounded(e.lgamma(F.col("p_size") + 0.5), 8), "round(lgamma(p_size + 0.5::DOUBLE), 8)")


_ERF = "1.1283791670955126 * list_sum([pow(-1, k) * pow(p_size / 20, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)) FOR k IN range(0, 60)])"


@query(f"SELECT p_partkey, round({_ERF}, 8) erf, round(1 - {_ERF}, 8) erfc FROM part")
def math_erf(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", e.rounded(e.erf(F.col("p_size") / 20), 8).alias("erf"), e.rounded(e.erfc(F.col("p_size") / 20), 8).alias("erfc"))


# ---- filters, folds, groups --------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def where_filter(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("SELECT pos FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 pos, o_totalprice FROM orders) WHERE o_totalprice > 200000")
def where_index(spark, sf_dir):
    return t.with_pos(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]).where("o_totalprice > 200000").select("pos")


@query("SELECT round(sum(l_extendedprice), 2) s, round(min(l_discount), 4) mn, max(l_quantity) mx, count(*) n, bool_and(l_quantity > 0) al, bool_or(l_tax > 0.07) an FROM lineitem")
def over_fold(spark, sf_dir):
    return t.over(read(spark, sf_dir, "lineitem"), s=e.rounded(F.sum(price), 2), mn=e.rounded(F.min(disc), 4), mx=F.max(qty), n=F.count("*"), al=F.bool_and(F.col(qty) > 0), an=F.bool_or(F.col(tax) > 0.07))


@query("SELECT r_regionkey, product(n_nationkey + 1)::DOUBLE p FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def over_product(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.product(F.col("n_nationkey") + 1).alias("p"))


@query("SELECT 0::BIGINT s, 1::DOUBLE p, 0::BIGINT n")
def over_empty(spark, sf_dir):
    empty = read(spark, sf_dir, "orders").where("o_orderkey < 0")
    return empty.agg(F.coalesce(F.sum("o_orderkey"), F.lit(0)).cast("long").alias("s"), F.coalesce(F.product("o_totalprice"), F.lit(1.0)).alias("p"), F.count("*").alias("n"))


@query("SELECT c_nationkey, CAST(2 * min_by(c_custkey, c_custkey) - sum(c_custkey) AS BIGINT) folded FROM customer GROUP BY 1")
def over_minus(spark, sf_dir):
    cust = read(spark, sf_dir, "customer").withColumn("pos", F.col("c_custkey"))
    lists = cust.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("l"))
    return lists.select("c_nationkey", c.over(lambda x, y: x - y, "l").alias("folded"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) s, count(*) n FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
def group_agg(spark, sf_dir):
    return t.group_agg(read(spark, sf_dir, "lineitem").where(F.col(qty) > 30), ["l_returnflag"], s=e.rounded(F.sum(price), 2), n=F.count("*"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) q, round(avg(l_discount), 8) d, count(*) n FROM lineitem GROUP BY 1, 2")
def multi_key_group(spark, sf_dir):
    return t.group_agg(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], q=F.sum(qty), d=e.rounded(F.avg(disc), 8), n=F.count("*"))


@query("SELECT n_regionkey, min(n_nationkey)::INT AS \"first\", list_sort(list(n_nationkey)) positions FROM nation GROUP BY 1")
def group_positions(spark, sf_dir):
    return t.group(read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")


@query("SELECT event_type, min(event_id) AS \"first\" FROM events GROUP BY 1")
def group_first_seen(spark, sf_dir):
    return t.distinct_first(read(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT count(DISTINCT l_partkey) parts, count(DISTINCT l_suppkey) supps FROM lineitem")
def count_distinct(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"))


@query("SELECT floor(o_totalprice / 50000)::BIGINT bucket, count(*) n FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return t.histogram(read(spark, sf_dir, "orders"), F.floor(F.col("o_totalprice") / 50000).cast("long"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) m FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(e.rounded(t.weighted_mean(price, qty), 6).alias("m"))


@query("SELECT p_brand, round(var_pop(p_retailprice), 4) v, round(stddev_pop(p_retailprice), 6) s, round(median(p_retailprice), 6) m, round(avg(p_retailprice), 6) a FROM part GROUP BY 1")
def statistics(spark, sf_dir):
    p = "p_retailprice"
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(e.rounded(F.var_pop(p), 4).alias("v"), e.rounded(F.stddev_pop(p), 6).alias("s"), e.rounded(F.median(p), 6).alias("m"), e.rounded(F.avg(p), 6).alias("a"))


@query("SELECT round(regr_slope(p_retailprice, p_size), 8) slope, round(regr_intercept(p_retailprice, p_size), 6) base FROM part")
def linear_fit(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(e.rounded(F.regr_slope("p_retailprice", "p_size"), 8).alias("slope"), e.rounded(F.regr_intercept("p_retailprice", "p_size"), 6).alias("base"))


@query("SELECT round(sum(l_quantity * l_extendedprice), 2) dot, round(sqrt(sum(l_quantity * l_quantity)), 6) mag FROM lineitem")
def dot_and_mag(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(e.rounded(F.sum(F.col(qty) * F.col(price)), 2).alias("dot"), e.rounded(F.sqrt(F.sum(F.col(qty) * F.col(qty))), 6).alias("mag"))


@query("SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 4) range, mode(o_orderstatus) IS NOT NULL has FROM orders GROUP BY 1")
def group_spread(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(e.rounded(F.max("o_totalprice") - F.min("o_totalprice"), 4).alias("range"), F.mode("o_orderstatus").isNotNull().alias("has"))


# ---- windows ------------------------------------------------------------------------

BY, BY_TS = ["user_id"], ["ts", "event_id"]
_W = "(PARTITION BY user_id ORDER BY ts, event_id"


def event(name, build, sql):
    def run(spark, sf_dir):
        return read(spark, sf_dir, "events").select("event_id", build().alias("v"))

    run.__name__ = name
    query(f"SELECT event_id, {sql} v FROM events")(run)


event("scan_sum", lambda: e.rounded(t.scan(F.sum, "value", BY, BY_TS), 4), f"round(sum(value) OVER {_W} ROWS UNBOUNDED PRECEDING), 4)")
event("scan_max", lambda: t.scan(F.max, "value", BY, BY_TS), f"max(value) OVER {_W} ROWS UNBOUNDED PRECEDING)")
event("scan_min", lambda: t.scan(F.min, "value", BY, BY_TS), f"min(value) OVER {_W} ROWS UNBOUNDED PRECEDING)")
event("first_diff", lambda: t.each_prior(lambda x, p: x - p, "value", BY, BY_TS), f"value - lag(value) OVER {_W})")
event("ratio", lambda: e.rounded(t.each_prior(lambda x, p: e.divide(x, p), "value", BY, BY_TS), 6), f"round(value / lag(value) OVER {_W}), 6)")
event("shift_back", lambda: F.lag("value", 2, 0.0).over(t.ordered(BY, BY_TS)), f"lag(value, 2, 0) OVER {_W})")
event("shift_ahead", lambda: F.lead("value", 1).over(t.ordered(BY, BY_TS)), f"lead(value) OVER {_W})")
event("moving_sum", lambda: e.rounded(t.moving(F.sum, "value", 3, BY, BY_TS), 4), f"round(sum(value) OVER {_W} ROWS 2 PRECEDING), 4)")
event("moving_max", lambda: t.moving(F.max, "value", 5, BY, BY_TS), f"max(value) OVER {_W} ROWS 4 PRECEDING)")
event("segment_of", lambda: t.segments(F.col("event_type") == "purchase", BY, BY_TS), f"CAST(sum((event_type = 'purchase')::INT) OVER {_W} ROWS UNBOUNDED PRECEDING) AS BIGINT)")
event("running_parity", lambda: t.segments(F.col("event_type") == "error", BY, BY_TS) % 2, f"CAST(sum((event_type = 'error')::INT) OVER {_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) % 2")


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) v FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER {_W} ROWS UNBOUNDED PRECEDING) seg FROM events)")
def segmented_scan(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("seg", t.segments(F.col("event_type") == "purchase", BY, BY_TS))
    return ev.select("event_id", e.rounded(t.scan(F.sum, "value", ["user_id", "seg"], BY_TS), 4).alias("v"))


@query(f"SELECT event_id, slid FROM (SELECT event_id, row_number() OVER {_W}) - 1 n, lead(value) OVER {_W}) - value slid FROM events) WHERE n % 2 = 0 AND slid IS NOT NULL")
def slide_pairs(spark, sf_dir):
    return t.slide(read(spark, sf_dir, "events"), lambda x, y: y - x, "value", BY, BY_TS, 2).select("event_id", "slid")


@query(f"SELECT user_id, event_type, length, count(*) n FROM (SELECT user_id, run, event_type, count(*) length FROM (SELECT *, sum(m) OVER {_W} ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER {_W}))::INT m FROM events)) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3")
def run_lengths(spark, sf_dir):
    return t.runs(read(spark, sf_dir, "events"), "event_type", BY, BY_TS).groupBy("user_id", "event_type", "length").agg(F.count("*").alias("n"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) running FROM events")
def global_scan(spark, sf_dir):
    out = t.global_scan(read(spark, sf_dir, "events").select("event_id", "value"), "value", ["event_id"])
    return out.select("event_id", e.rounded("running", 2).alias("running"))


# ---- order ---------------------------------------------------------------------------


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS \"rank\" FROM customer")
def grade_up(spark, sf_dir):
    ranked = t.with_pos(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "rank")
    return ranked.select("c_custkey", "rank")


@query("SELECT c_custkey, row_number() OVER (ORDER BY -c_acctbal, c_custkey) - 1 AS \"rank\" FROM customer")
def grade_down(spark, sf_dir):
    down = read(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("k"))
    return t.with_pos(down, ["k", "c_custkey"], "rank").select("c_custkey", "rank")


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) - 1 d FROM customer")
def rank_shareable(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    return read(spark, sf_dir, "customer").select("c_custkey", (F.rank().over(w.orderBy("c_mktsegment")) - 1).cast("long").alias("r"), (F.row_number().over(w.orderBy("c_mktsegment", "c_custkey")) - 1).cast("long").alias("d"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) - 1 AS \"rank\" FROM customer")
def multi_key_sort(spark, sf_dir):
    cols = ["c_nationkey", "c_mktsegment", "c_custkey"]
    return t.with_pos(read(spark, sf_dir, "customer").select(*cols), cols, "rank").select("c_custkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return t.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def take_tail(spark, sf_dir):
    return t.top(read(spark, sf_dir, "orders").select("o_orderkey"), 7, F.desc("o_orderkey"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY list_position(['MACHINERY','AUTOMOBILE','BUILDING','HOUSEHOLD','FURNITURE'], c_mktsegment), c_custkey) - 1) AS \"rank\" FROM customer")
def sort_by_table(spark, sf_dir):
    order_ = F.array_position(F.array(*[F.lit(x) for x in ("MACHINERY", "AUTOMOBILE", "BUILDING", "HOUSEHOLD", "FURNITURE")]), F.col("c_mktsegment"))
    keyed = read(spark, sf_dir, "customer").select("c_custkey", order_.alias("k"))
    return t.with_pos(keyed, ["k", "c_custkey"], "rank").select("c_custkey", "rank")


# ---- lookups, joins, sets ---------------------------------------------------------------


@query("SELECT o_orderkey, coalesce(p, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0)) found FROM orders LEFT JOIN (SELECT c_custkey, c_custkey p FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def find_lookup(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("pos"))
    return t.find(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), a, "o_custkey", "k", "pos").select("o_orderkey", "found")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def gather_join(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return t.gather(t.gather(read(spark, sf_dir, "customer"), n, "c_nationkey"), r, "n_regionkey").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def semi_lin(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.members(read(spark, sf_dir, "orders"), rich, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def anti_dvl(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.without(read(spark, sf_dir, "orders"), rich, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))::INT mask FROM orders")
def member_mask(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("mask"))
    return read(spark, sf_dir, "orders").join(rich, "o_custkey", "left").select("o_orderkey", F.coalesce("mask", F.lit(0)).alias("mask"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (1, 5, 7)")
def delete_index(spark, sf_dir):
    gone = spark.createDataFrame([(1,), (5,), (7,)], "s_suppkey long")
    return t.delete_at(read(spark, sf_dir, "supplier"), gone, "s_suppkey").select("s_suppkey")


@query("SELECT a.n_nationkey a, b.r_regionkey b, (a.n_nationkey < b.r_regionkey)::INT AS \"value\" FROM nation a, region b")
def cross_each(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    b = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("b"))
    return t.pairs(a, b, (F.col("a") < F.col("b")).cast("int"))


@query("SELECT c_custkey k, c_acctbal + s_acctbal v FROM customer JOIN supplier ON c_custkey = s_suppkey")
def zip_each(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return a.join(b, "k").select("k", (F.col("c_acctbal") + F.col("s_acctbal")).alias("v"))


@query("SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < c_acctbal) cell FROM customer")
def asof_bin(spark, sf_dir):
    cust = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    supp = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("y"))
    return t.bin_below(cust, supp, "x", "y", ["k"]).select("c_custkey", F.col("cell").cast("long").alias("cell"))


@query("SELECT o_orderkey, ((o_totalprice > 50000)::INT + (o_totalprice > 100000)::INT + (o_totalprice > 250000)::INT) cell FROM orders")
def classify_bin(spark, sf_dir):
    return t.classify(read(spark, sf_dir, "orders"), "o_totalprice", [50000, 100000, 250000]).select("o_orderkey", "cell")


@query("SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def difference(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey"))
    return t.without(read(spark, sf_dir, "customer"), s, "c_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def intersection(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey"))
    return t.members(read(spark, sf_dir, "customer"), s, "c_nationkey").select("c_custkey")


@query("SELECT NOT EXISTS (SELECT 1 FROM orders ANTI JOIN customer ON o_custkey = c_custkey) AS subset")
def subset(spark, sf_dir):
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return t.without(read(spark, sf_dir, "orders"), cust, "o_custkey").agg((F.count("*") == 0).alias("subset"))


@query("WITH RECURSIVE p(a, b) AS (SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation UNION SELECT p.a, (p.b * 3 + 1) % 25 FROM p) SELECT a, b FROM p")
def transitive_closure(spark, sf_dir):
    edges = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b"))
    return t.closure(edges)


# ---- cells ---------------------------------------------------------------------------------


def cell(name, build, sql):
    def run(spark, sf_dir):
        v = F.col("embedding").cast("array<double>")
        return read(spark, sf_dir, "embeddings").withColumn("v", v).select("vec_id", build("v").alias("r"))

    run.__name__ = name
    query(f"SELECT vec_id, {sql} r FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)")(run)


cell("take", lambda v: c.take(5, v), "v[1:5]")
cell("take_last", lambda v: c.take(-3, v), "v[62:64]")
cell("take_cyclic", lambda v: c.take(70, v), "list_concat(v, v[1:6])")
cell("drop", lambda v: c.drop(60, v), "v[61:]")
cell("drop_last", lambda v: c.drop(-60, v), "v[1:4]")
cell("reverse", lambda v: c.reverse(v), "list_reverse(v)")
cell("rotate", lambda v: c.rotate(3, v), "list_concat(v[4:], v[1:3])")
cell("enlist", lambda v: c.enlist(F.get(F.col(v), 0)), "[v[1]]")
cell("first", lambda v: c.first(v), "v[1]")
cell("count_items", lambda v: c.count(v), "len(v)::INT")
cell("join", lambda v: c.join(v, c.reverse(v)), "list_concat(v, list_reverse(v))")
cell("cut", lambda v: c.cut([0, 10, 60], v), "[v[1:10], v[11:60], v[61:64]]")
cell("raze", lambda v: c.raze(c.cut([0, 10, 60], v)), "v")
cell("reshape_rows", lambda v: c.reshape(v, None, 24), "[v[1:24], v[25:48], v[49:64]]")
cell("reshape_parts", lambda v: c.reshape(v, 3, None), "[v[1:21], v[22:42], v[43:64]]")
cell("flip", lambda v: c.flip(c.reshape(v, 8, 8)), "[[v[(i - 1) * 8 + j] FOR i IN range(1, 9)] FOR j IN range(1, 9)]")
cell("shape", lambda v: c.shape(c.reshape(v, 8, 8)), "[8, 8]")
cell("amend_at", lambda v: c.amend(v, [1, 2], lambda x: x * 0), "[CASE WHEN i IN (2, 3) THEN v[i] * 0 ELSE v[i] END FOR i IN range(1, 65)]")
cell("amend_path", lambda v: c.amend_path(c.reshape(v, 8, 8), 1, 0, lambda x: -x), "[[CASE WHEN i = 2 AND j = 1 THEN -v[9] ELSE v[(i - 1) * 8 + j] END FOR j IN range(1, 9)] FOR i IN range(1, 9)]")
cell("delete_items", lambda v: c.delete_at(v, [0, 2]), "list_concat([v[2]], v[4:])")
cell("at_null", lambda v: c.gather(v, F.array(F.lit(0), F.lit(99), F.lit(5))), "[v[1], v[100], v[6]]")
cell("gather_items", lambda v: c.gather(v, F.array(F.lit(5), F.lit(0))), "[v[6], v[1]]")
cell("where_positive", lambda v: c.where(F.transform(F.col(v), lambda x: (x > 0.2).cast("int"))), "list_filter(list_transform(range(0, 64), lambda i: CASE WHEN v[i + 1] > 0.2 THEN i::INT END), lambda x: x IS NOT NULL)")
cell("find_item", lambda v: c.find(v, F.get(F.col(v), 7)), "(list_position(v, v[8]) - 1)::BIGINT")
cell("member_items", lambda v: c.members(v, c.drop(40, v)), "[list_contains(v[41:], x)::INT FOR x IN v]")
cell("without_items", lambda v: c.without(v, F.filter(v, lambda x: x > 0.1)), "list_filter(v, lambda x: NOT list_contains(list_filter(v, lambda y: y > 0.1::DOUBLE), x))")
cell("grade_cell", lambda v: c.grade(v), "list_transform(list_grade_up(v), lambda x: (x - 1)::INT)")
cell("bin_cell", lambda v: c.below(F.array(*[F.lit(x) for x in (-0.2, 0.0, 0.2)]), F.get(F.col(v), 0)), "((v[1] > -0.2::DOUBLE)::INT + (v[1] > 0)::INT + (v[1] > 0.2::DOUBLE)::INT)")
cell("each", lambda v: c.each(lambda x: x * x, v), "[x * x FOR x IN v]")
cell("each_pair", lambda v: c.each2(lambda x, y: x - y, v, c.reverse(v)), "[v[i] - v[65 - i] FOR i IN range(1, 65)]")
cell("each_right", lambda v: c.each_right(lambda x, y: F.get(x, 0) + y, v, v), "[v[1] + y FOR y IN v]")
cell("each_left", lambda v: c.each_left(lambda x, y: x - F.get(y, 63), v, v), "[x - v[64] FOR x IN v]")
cell("each_n", lambda v: c.each_n(lambda x, y, z: x + y * z, v, c.reverse(v), c.rotate(1, v)), "[v[i] + v[65 - i] * v[i % 64 + 1] FOR i IN range(1, 65)]")
cell("outer_table", lambda v: c.table_of(lambda x, y: x * y, F.transform(c.reshape(v, 8, 8), F.array_max), F.transform(c.reshape(v, 8, 8), F.array_min)), "[[list_max(v[(i - 1) * 8 + 1:i * 8]) * list_min(v[(j - 1) * 8 + 1:j * 8]) FOR j IN range(1, 9)] FOR i IN range(1, 9)]")
cell("fold_lambda", lambda v: e.rounded(c.over(lambda a, b: a * 0.5 + b, v), 9), "round(list_reduce(v, lambda a, b: a * 0.5 + b), 9)")
cell("seeded_fold", lambda v: e.rounded(c.over(lambda a, b: a + b, v, F.lit(10.0)), 9), "round(list_reduce(list_prepend(10.0::DOUBLE, v), lambda a, b: a + b), 9)")
cell("fold_many", lambda v: e.rounded(c.fold_many(lambda a, x, y: a + x * y, F.lit(0.0), v, c.reverse(v)), 9), "round(list_sum(list_transform(range(1, 65), lambda i: v[i] * v[65 - i])), 9)")
cell("scan_lambda", lambda v: F.transform(c.scan(lambda a, b: a + b, v), lambda x: e.rounded(x, 9)), "[round(list_sum(v[1:i]), 9) FOR i IN range(1, 65)]")
cell("scan_seeded", lambda v: F.transform(c.scan(lambda a, b: a + b, v, F.lit(10.0)), lambda x: e.rounded(x, 9)), "list_prepend(10.0::DOUBLE, [round(10 + list_sum(v[1:i]), 9) FOR i IN range(1, 65)])")
cell("scan_does", lambda v: c.do_scan(5, lambda x: x * 2 + 1, F.floor(F.get(v, 0) * 100).cast("long")), "[floor(v[1] * 100)::BIGINT * (1 << k) + (1 << k) - 1 FOR k IN range(0, 6)]")
cell("scan_while", lambda v: c.while_scan(lambda x: x < 100, lambda x: x * 2 + 1, F.floor(F.abs(F.get(v, 0)) * 50).cast("long")), "[(floor(abs(v[1]) * 50)::BIGINT + 1) * (1 << k) - 1 FOR k IN range(0, 9) IF k = 0 OR (floor(abs(v[1]) * 50)::BIGINT + 1) * (1 << greatest(k - 1, 0)) - 1 < 100]")
cell("scan_converge", lambda v: c.converge_scan(lambda x: F.floor(x / 2).cast("long"), F.floor(F.abs(F.get(v, 0)) * 1000).cast("long")), "[floor(abs(v[1]) * 1000)::BIGINT >> k FOR k IN range(0, 12) IF k = 0 OR floor(abs(v[1]) * 1000)::BIGINT >> greatest(k - 1, 0) > 0]")
cell("converge", lambda v: c.converge(lambda x: F.floor((x + 100) / 2).cast("long"), F.floor(F.abs(F.get(v, 0)) * 50).cast("long")), "99::BIGINT")
cell("do_over", lambda v: e.rounded(c.do(5, lambda x: x * 2 + 1, F.get(F.col(v), 0)), 9), "round(v[1] * 32 + 31, 9)")
cell("while_over", lambda v: c.while_(lambda x: x < 100, lambda x: x * 2 + 1, F.floor(F.abs(F.get(F.col(v), 0)) * 50).cast("long")), "list_min([(floor(abs(v[1]) * 50)::BIGINT + 1) * (1 << k) - 1 FOR k IN range(0, 8) IF (floor(abs(v[1]) * 50)::BIGINT + 1) * (1 << k) > 100])::BIGINT")
cell("slide_cell", lambda v: c.slide(lambda x, y: y - x, v), "[v[i + 1] - v[i] FOR i IN range(1, 64)]")
cell("dot_cell", lambda v: e.rounded(c.dot(v, c.reverse(v)), 8), "round(list_dot_product(v, list_reverse(v)), 8)")
cell("mag_cell", lambda v: e.rounded(c.mag(v), 8), "round(sqrt(list_dot_product(v, v)), 8)")
cell("poly_value", lambda v: e.rounded(c.poly(v, F.lit(0.5)), 9), "round(list_reduce(v, lambda a, b: a * 0.5::DOUBLE + b), 9)")


@query("SELECT user_id, [x FOR x IN list_transform(['click','error','purchase','signup','view'], lambda y: len(list_filter(l, lambda z: z = y))) ] counts FROM (SELECT user_id, list(event_type) l FROM events GROUP BY 1)")
def group_cell(spark, sf_dir):
    lists = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return lists.select("user_id", F.transform(kinds, lambda y: F.size(F.filter("l", lambda z: z == y)).cast("long")).alias("counts"))


@query("SELECT row, items FROM (SELECT floor(o_orderkey / 1000)::BIGINT row, list(o_custkey ORDER BY o_orderkey) items FROM orders GROUP BY 1)")
def reshape_table(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey")
    return t.reshape_rows(o, 1000, "o_custkey")


@query("SELECT ((n_nationkey >= 5)::INT + (n_nationkey >= 12)::INT) - 1 AS piece, list(n_name ORDER BY n_nationkey) items FROM nation WHERE n_nationkey >= 5 GROUP BY 1")
def cut_table(spark, sf_dir):
    return t.cut_rows(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), "n_name"), [5, 12], "n_name")


@query("SELECT s_suppkey pos, CASE WHEN s_suppkey IN (2, 3) THEN 0.0::DOUBLE ELSE s_acctbal END s_acctbal FROM supplier")
def amend_table(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), "s_acctbal")
    return t.amend(s, spark.createDataFrame([(2, 0.0), (3, 0.0)], "pos long, s_acctbal double"), "s_acctbal")


@query("SELECT (s_suppkey - 10 + n) % n pos, s_name FROM supplier, (SELECT count(*) n FROM supplier)")
def rotate_table(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), "s_name")
    return t.rotate(s, 10, s.count())


# ---- text, codecs, dates, numbers ---------------------------------------------------------------


def doc(name, build, sql):
    simple(name, "documents", {"doc_id": lambda: F.col("doc_id"), "r": build}, f"doc_id, {sql} r")


doc("str_find_first", lambda: text.find_first("text", "the").cast("long"), "(strpos(text, 'the') - 1)::BIGINT")
doc("str_glob", lambda: text.matches("source", "src[1-3]*"), "regexp_full_match(source, 'src[1-3].*')::INT")
doc("str_find_all", lambda: F.size(text.find_all("text", "th?")).cast("long"), "len(regexp_extract_all(text, '(?s)th.'))")
doc("str_find_words", lambda: F.size(text.find_all("text", "en", word=True)).cast("long"), "len(regexp_extract_all(text, '\\ben\\b'))")
doc("str_replace", lambda: F.md5(text.replace("text", "the", "THE")), "md5(replace(text, 'the', 'THE'))")
doc("pad_left", lambda: text.pad(10, "source"), "lpad(source, 10, ' ')")
doc("pad_right", lambda: text.pad(-10, "source"), "rpad(source, 10, ' ')")
doc("pad_cut", lambda: text.pad(3, "source"), "right(source, 3)")
doc("char_code", lambda: text.char_code("text"), "ascii(text)::INT")
doc("char_codes", lambda: text.char_codes("lang"), "[ascii(lang[1])::INT, ascii(lang[2])::INT]")
doc("from_codes", lambda: text.from_codes(text.char_codes("source")), "source")
doc("md5_hex", lambda: codec.md5("text"), "md5(text)")
doc("sha1_hex", lambda: codec.sha1("text"), "sha1(text)")
doc("sha256_hex", lambda: codec.sha2("text"), "sha256(text)")
doc("hex_bytes", lambda: codec.to_hex("source"), "lower(hex(source))")
doc("unhex_bytes", lambda: codec.from_hex(codec.to_hex("source")).cast("string"), "source")
doc("compress_round", lambda: F.md5(codec.decompress(codec.compress("text"))), "md5(text)")
doc("serialize_round", lambda: codec.deserialize(codec.serialize("source"), "string"), "source")
doc("trim_blanks", lambda: F.length(F.regexp_replace("text", "  +", " ")).cast("long"), "length(regexp_replace(text, '  +', ' ', 'g'))")
part("format_number", lambda: text.number(12, 2, "p_retailprice"), "lpad(printf('%.2f', p_retailprice), 12, ' ')")
part("format_overflow", lambda: text.number(6, 2, "p_retailprice"), "CASE WHEN p_retailprice >= 999.995 THEN '******' ELSE lpad(printf('%.2f', p_retailprice), 6, ' ') END")
part("cast_int", lambda: text.parse(F.regexp_extract("p_brand", "([0-9]+)", 1), "int"), "TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)")
part("cast_bad", lambda: text.parse("p_name", "double"), "TRY_CAST(p_name AS DOUBLE)")
part("base_encode", lambda: text.encode_base(2, "p_partkey", 8), "list_transform(range(greatest(8, len(bin(p_partkey))) - 1, -1, -1), lambda i: ((p_partkey >> i) & 1)::BIGINT)")
part("base_decode", lambda: text.decode_base(2, text.encode_base(2, "p_partkey")), "p_partkey")
part("radix_encode", lambda: text.encode_mixed([24, 60, 60], F.col("p_partkey")), "[(p_partkey // 3600)::BIGINT, (p_partkey // 60 % 60)::BIGINT, (p_partkey % 60)::BIGINT]")
part("radix_decode", lambda: text.decode_base([24, 60, 60], text.encode_mixed([24, 60, 60], F.col("p_partkey"))), "p_partkey")
order("jd_day", lambda: dates.day_number(dates.yyyymmdd("o_orderdate")), "date_diff('day', DATE '2035-01-01', o_orderdate::DATE)::INT")
order("dj_date", lambda: dates.from_day(dates.day_number(dates.yyyymmdd("o_orderdate"))), "strftime(o_orderdate, '%Y%m%d')::INT")
order("leap_year", lambda: dates.leap(F.year("o_orderdate")), "((year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0)::INT")
order("days_in_month", lambda: dates.days_in_month("o_orderdate"), "day(last_day(o_orderdate))::INT")
simple("gtime", "events", {"event_id": lambda: F.col("event_id"), "day": lambda: dates.clock(dates.seconds("ts"))["day"], "time": lambda: dates.clock(dates.seconds("ts"))["time"]}, "event_id, strftime(ts, '%Y%m%d')::INT AS \"day\", strftime(ts, '%H%M%S')::INT AS \"time\"")
simple("local_round", "events", {"event_id": lambda: F.col("event_id"), "s": lambda: dates.to_gmt(dates.to_local(dates.seconds("ts"), "Asia/Tokyo"), "Asia/Tokyo")}, "event_id, (floor(epoch(ts))::BIGINT - 2051222400) s")
part("prime_flag", lambda: nt.prime("p_partkey"), "(p_partkey > 1 AND len(list_filter(range(2, 64), lambda d: d < p_partkey AND p_partkey % d = 0)) = 0)::INT")
part("gcd", lambda: nt.gcd("p_partkey", "p_size"), "gcd(p_partkey, p_size)::BIGINT")
part("lcm", lambda: nt.lcm(F.col("p_partkey") + 1, F.when(F.col("p_size") != 7, F.col("p_size"))), "CASE WHEN p_size <> 7 THEN lcm(p_partkey + 1, p_size)::BIGINT END")
part("floor_float", lambda: e.floor_float("p_retailprice"), "floor(p_retailprice)::DOUBLE")
part("significant", lambda: text.significant(F.col("p_size") / 4, 7), "regexp_replace(printf('%.2f', p_size / 4), '\\.?0+$', '')")
part("roman", lambda: text.to_roman("p_size"), "repeat('L', p_size // 50) || (['', 'X', 'XX', 'XXX', 'XL'])[p_size % 50 // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[p_size % 10 + 1]")
part("arabic", lambda: text.from_roman(text.to_roman("p_size")), "p_size")


@query(
    "WITH RECURSIVE f(k, n, d, l) AS (SELECT p_partkey, p_partkey + 2, 2::BIGINT, []::BIGINT[] FROM part UNION ALL "
    "SELECT k, CASE WHEN n % d = 0 THEN n // d ELSE n END::BIGINT, CASE WHEN n % d = 0 THEN d WHEN d = 2 THEN 3 ELSE d + 2 END::BIGINT, CASE WHEN n % d = 0 THEN list_append(l, d) ELSE l END FROM f WHERE d * d <= n) "
    "SELECT k AS p_partkey, CASE WHEN n > 1 THEN list_append(l, n) ELSE l END AS factors FROM f WHERE d * d > n"
)
def factor_list(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", nt.factor(F.col("p_partkey") + 2).alias("factors"))


@query("SELECT p_partkey, CASE WHEN gcd(p_partkey, 101) = 1 THEN [x FOR x IN range(1, 101) IF p_partkey % 101 * x % 101 = 1][1] ELSE -1 END inv FROM part")
def modinv(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", nt.modinv("p_partkey", F.lit(101)).alias("inv"))


@query("SELECT doc_id, source AS opened, 2 * octet_length(encode(source))::INT AS size FROM documents")
def aes_counter(spark, sf_dir):
    """Sealed and opened again; a published vector is among the tests."""
    key, iv = "00" * 31 + "01", "00" * 15 + "07"
    d = read(spark, sf_dir, "documents").select("doc_id", codec.aes_ctr("source", key, iv).alias("sealed"))
    return d.select("doc_id", F.unhex(codec.aes_ctr(F.unhex("sealed"), key, iv)).cast("string").alias("opened"), F.length("sealed").alias("size"))


_U = "(('0x' || substr(md5('{}:' || {}), 1, 13))::BIGINT / 4503599627370496)"


@query("SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 20")
def deal(spark, sf_dir):
    return draws.deal(read(spark, sf_dir, "customer").select("c_custkey"), 20, 7, "c_custkey")


@query(f"SELECT o_orderkey, floor(6 * {_U.format(3, 'o_orderkey')})::BIGINT r, {_U.format(5, 'o_orderkey')} u FROM orders")
def roll(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", draws.roll(6, 3, "o_orderkey").alias("r"), draws.uniform(5, "o_orderkey").alias("u"))


@query("SELECT s_suppkey, [[floor(10 * " + _U.format(9, "s_suppkey || ',' || i || ',' || j") + ")::BIGINT FOR j IN range(0, 3)] FOR i IN range(0, 2)] r FROM supplier")
def roll_shaped(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", draws.rolls([2, 3], 10, 9, "s_suppkey").alias("r"))


# ---- matrices ---------------------------------------------------------------------------------------


def _coo(spark, sf_dir):
    return la.coordinates(read(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"))


@query("WITH e AS (SELECT vec_id i, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::DOUBLE v FROM embeddings) SELECT a.j::INT i, b.j::INT j, round(sum(a.v * b.v), 6) v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2")
def gram(spark, sf_dir):
    x = _coo(spark, sf_dir)
    return la.mul(la.flip(x), x).select("i", "j", e.rounded("v", 6).alias("v"))


@query("SELECT generate_subscripts(embedding, 1)::INT - 1 i, vec_id j, unnest(embedding)::DOUBLE v FROM embeddings")
def mat_transpose(spark, sf_dir):
    return la.flip(_coo(spark, sf_dir))


def _matrices(spark, sf_dir):
    """A well-conditioned 8 x 8 matrix per vector: its reshape plus 3 on the diagonal."""
    v = read(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return v.select("vec_id", F.array(*[F.array(*[F.get("v", 8 * i + j) + (3.0 if i == j else 0.0) for j in range(8)]) for i in range(8)]).alias("m"))


def _rounded(m, digits=6):
    return F.transform(F.flatten(m), lambda x: e.rounded(x, digits) + 0.0)


_LIFTED = "[round(v[i] + CASE WHEN (i - 1) % 9 = 0 THEN 3 ELSE 0 END, 6) + 0.0::DOUBLE FOR i IN range(1, 65)]"
_VECTORS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)"


def _rebuilt(name, kind):
    """The product of the factors, which must be the matrix, value by value."""

    def run(spark, sf_dir):
        return _matrices(spark, sf_dir).select("vec_id", F.flatten(la.rebuilt(kind, "m", 6)).alias("r"))

    run.__name__ = name
    query(f"SELECT vec_id, {_LIFTED} r FROM {_VECTORS}")(run)


_rebuilt("lu", "lu")
_rebuilt("ldu", "ldu")
_rebuilt("qr", "qr")
_rebuilt("svd", "svd")


def _small(v):
    """A 2 x 2 matrix of the first four components, 3 added on the diagonal."""
    return F.array(F.array(F.get(v, 0) + 3, F.get(v, 1)), F.array(F.get(v, 2), F.get(v, 3) + 3))


def _factor(name, kind, matrix, sql, which=0):
    """A factor of a small matrix of each vector against its closed form."""

    def run(spark, sf_dir):
        v = read(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
        d = v.select("vec_id", matrix("v").alias("m")).withColumn("f", F.get(la.decompose(kind, "m"), which))
        return d.select("vec_id", _rounded(F.col("f")).alias("r"))

    run.__name__ = name
    query(f"SELECT vec_id, [round(x, 6) + 0.0::DOUBLE FOR x IN {sql}] r FROM (SELECT vec_id, v, v[1] + 3 a, v[2] b, v[3] c, v[4] + 3 d FROM {_VECTORS})")(run)


_factor("lu_lower", "lu", _small, "[1.0::DOUBLE, 0.0::DOUBLE, c / a, 1.0::DOUBLE]", 1)
_factor("lu_upper", "lu", _small, "[a, b, 0.0::DOUBLE, d - c / a * b]", 2)
_factor("ldu_diagonal", "ldu", _small, "[a, 0.0::DOUBLE, 0.0::DOUBLE, d - c / a * b]", 2)
_factor("svd_values", "svd", _small, "[sqrt((a*a + b*b + c*c + d*d + sqrt(pow(a*a + b*b - c*c - d*d, 2) + 4 * pow(a*c + b*d, 2))) / 2), 0.0::DOUBLE, 0.0::DOUBLE, sqrt((a*a + b*b + c*c + d*d - sqrt(pow(a*a + b*b - c*c - d*d, 2) + 4 * pow(a*c + b*d, 2))) / 2)]", 1)
_factor("inv", "inv", _small, "[d / (a * d - b * c), -b / (a * d - b * c), -c / (a * d - b * c), a / (a * d - b * c)]")
_factor("det", "det", _small, "[a * d - b * c]")
_factor("rref", "rref", lambda v: F.array(F.array(F.get(v, 0) + 3, F.get(v, 1), F.get(v, 4)), F.array(F.get(v, 2), F.get(v, 3) + 3, F.get(v, 5))), "[1.0::DOUBLE, 0.0::DOUBLE, (v[5] * d - b * v[6]) / (a * d - b * c), 0.0::DOUBLE, 1.0::DOUBLE, (a * v[6] - v[5] * c) / (a * d - b * c)]")


@query("SELECT p_brand, round(regr_intercept(p_retailprice, p_size), 5) a, round(regr_slope(p_retailprice, p_size), 6) b FROM part GROUP BY 1")
def lsq(spark, sf_dir):
    s = la.fit(read(spark, sf_dir, "part"), ["p_brand"], [F.lit(1.0), F.col("p_size")], F.col("p_retailprice"), "s")
    return s.select("p_brand", e.rounded(F.get("s", 0), 5).alias("a"), e.rounded(F.get("s", 1), 6).alias("b"))


@query("SELECT p_brand, round(exp(regr_intercept(ln(p_retailprice), p_size)), 5) a, round(exp(regr_slope(ln(p_retailprice), p_size)), 8) b FROM part GROUP BY 1")
def exponential_fit(spark, sf_dir):
    s = la.fit(read(spark, sf_dir, "part"), ["p_brand"], [F.lit(1.0), F.col("p_size")], F.log("p_retailprice"), "s")
    return s.select("p_brand", e.rounded(F.exp(F.get("s", 0)), 5).alias("a"), e.rounded(F.exp(F.get("s", 1)), 8).alias("b"))


# ---- streams: whole tables through Structured Streaming ------------------------------------------------


def _stream(spark, sf_dir, name):
    from quiver.streaming import live

    return live.files(spark, f"{sf_dir}/{name}.parquet*", read(spark, sf_dir, name))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) since, event_type, count(*) n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    from quiver.streaming import live

    got = live.drain(live.windows(_stream(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", ["event_type"]), mode="complete")
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("since"), "event_type", "n")


@query("SELECT user_id, count(*) n, round(sum(value), 4) s FROM events GROUP BY 1")
def stream_running(spark, sf_dir):
    from quiver.streaming import live

    got = live.drain(live.running(_stream(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value"), mode="update")
    return got.select("user_id", "n", e.rounded("s", 4).alias("s"))


@query("SELECT count(*) n, count(DISTINCT user_id) users FROM events")
def stream_watch(spark, sf_dir):
    """A watcher sees every new row of a table once."""
    from quiver.streaming import live

    seen = []
    live.watch(_stream(spark, sf_dir, "events"), lambda df, n: seen.append(df.agg(F.count("*"), F.countDistinct("user_id")).first())).awaitTermination()
    return spark.createDataFrame([tuple(r) for r in seen], "n long, users long")


@query("SELECT event_type, count(*) n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def stream_handlers(spark, sf_dir):
    """Rows go to the handler of their kind; the handlers of two kinds count theirs."""
    from quiver.streaming import live

    seen = {"click": 0, "view": 0}
    count = lambda kind: lambda df, n: seen.update({kind: seen[kind] + df.count()})
    live.handlers(_stream(spark, sf_dir, "events"), "event_type", {k: count(k) for k in seen}).awaitTermination()
    return spark.createDataFrame([(k, n) for k, n in seen.items() if n], "event_type string, n long")


@query("SELECT user_id, since, count(*) n FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id, s) since FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT user_id, ts, event_id, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true))::INT f FROM events))) GROUP BY 1, 2")
def stream_sessions(spark, sf_dir):
    from quiver.streaming import live

    got = live.drain(live.sessions(_stream(spark, sf_dir, "events"), "ts", "30 minutes", "10 minutes", ["user_id"]), mode="complete")
    return got.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("since"), "n")


@query("SELECT unnest([0, 1]) AS tick")
def timer_ticks(spark, sf_dir):
    """The first two ticks of a recurring call; calls never overlap."""
    import time

    from quiver.streaming import live

    ticks, end = [], time.time() + 60
    handle = live.timer(spark, 0.1, ticks.append)
    try:
        while len(ticks) < 2 and time.time() < end:
            time.sleep(0.02)
    finally:
        handle.stop()
    return spark.createDataFrame([(int(x),) for x in ticks[:2]], "tick int")


@query("SELECT count(*) n FROM events")
def stream_barrier(spark, sf_dir):
    """All that has come is handled once the barrier returns."""
    from quiver.streaming import live

    seen = []
    q = _stream(spark, sf_dir, "events").writeStream.foreachBatch(lambda df, n: seen.append(df.count())).start()
    try:
        live.barrier(q)
    finally:
        q.stop()
    return spark.createDataFrame([(sum(seen),)], "n long")


# ---- vectors as a whole ---------------------------------------------------------------------------------


@query("SELECT event_id, round(sum(value) OVER (ORDER BY k NULLS FIRST, event_id), 2) running FROM (SELECT event_id, value, CASE WHEN event_id % 7 <> 0 THEN value END k FROM events)")
def global_scan_nulls(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("k"))
    return t.global_scan(ev, "value", ["k", "event_id"]).select("event_id", e.rounded("running", 2).alias("running"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_type DESC, event_id) - 1 AS \"rank\" FROM events")
def grade_keys(spark, sf_dir):
    return t.grade(read(spark, sf_dir, "events").select("event_id", "event_type"), [F.desc("event_type")], "event_id").select("event_id", "rank")


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, c_custkey AS \"rank\" FROM customer")
def invert_permutation(spark, sf_dir):
    ranked = t.with_pos(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "rank")
    return t.inverse(ranked, "rank", "c_custkey").select(F.col("c_custkey").alias("pos"), "rank")


@query("SELECT bool_and(p IS NULL OR p <= o_orderkey) sorted FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) p FROM orders)")
def is_sorted(spark, sf_dir):
    return t.is_sorted(read(spark, sf_dir, "orders"), "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) cell FROM customer")
def bin_all(spark, sf_dir):
    cust, supp = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), read(spark, sf_dir, "supplier").select("s_acctbal")
    return t.bin_below(cust, supp, "c_acctbal", "s_acctbal").select("c_custkey", "cell")


@query("SELECT (i // n) * n + p pos, v FROM (SELECT n_nationkey p, n_name v FROM nation), (SELECT count(*) n FROM nation), (SELECT unnest([0, 25, 50]) i) WHERE i + p < 60")
def take_turns(spark, sf_dir):
    return t.take(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("v")), 60)


@query("SELECT row_number() OVER (ORDER BY p, k, o) - 1 pos, v FROM (SELECT n_nationkey p, 0 k, 0 o, n_name v FROM nation UNION ALL SELECT 2, 1, 0, 'first' UNION ALL SELECT 2, 1, 1, 'second' UNION ALL SELECT -1, 1, 0, 'ahead')")
def insert_rows(spark, sf_dir):
    v = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("v"))
    new = spark.createDataFrame([(2, 0, "first"), (2, 1, "second"), (-1, 0, "ahead")], "after long, turn int, v string")
    return t.insert_after(v, new, "v")


@query("SELECT l_returnflag, l_linestatus, sum(l_linenumber * l_linenumber)::BIGINT folded FROM lineitem GROUP BY 1, 2")
def user_fold_parts(spark, sf_dir):
    from quiver.functions import udf

    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return udf.fold_parts(rows, ["l_returnflag", "l_linestatus"], "l_linenumber", lambda a, x: a + x * x, lambda a, b: a + b, 0, "long")


@query("SELECT bool_and(a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus) AS \"match\" FROM orders a FULL JOIN orders b USING (o_orderkey)")
def match_vectors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    return t.match(o, o.select("pos", "o_orderstatus").where("true"), "o_orderstatus")


@query("SELECT (SELECT list_sort(list(DISTINCT c_nationkey)) FROM customer) = (SELECT list_sort(list(DISTINCT s_nationkey)) FROM supplier) equal")
def set_equal(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return t.set_equal(a, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT (SELECT list_sort(list(o_custkey)) FROM orders) = (SELECT list_sort(list(o_custkey + 0)) FROM orders) permutation")
def permuted(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return t.permuted(o, o.orderBy(F.desc("k")), "k")


@query("SELECT a.pos, x, y FROM (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 pos, c_custkey x FROM customer) a JOIN (SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 pos, c_custkey y FROM customer) b USING (pos)")
def zip_positions(spark, sf_dir):
    cust = read(spark, sf_dir, "customer")
    a = t.with_pos(cust.select("c_acctbal", F.col("c_custkey").alias("x")), ["c_acctbal", "x"]).select("pos", "x")
    return t.zip_rows(a, t.with_pos(cust.select("c_name", F.col("c_custkey").alias("y")), ["c_name", "y"]).select("pos", "y"))


@query("SELECT c_nationkey, round(list_reduce(list(c_custkey::DOUBLE ORDER BY c_custkey), lambda a, b: a / b), 12) folded FROM customer WHERE c_custkey > 0 GROUP BY 1")
def over_divide(spark, sf_dir):
    cust = read(spark, sf_dir, "customer").where("c_custkey > 0").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.col("c_custkey").cast("double"))).alias("l"))
    return cust.select("c_nationkey", e.rounded(c.over(lambda x, y: e.divide(x, y), "l"), 12).alias("folded"))


@query("SELECT n a, 2 * n b FROM (SELECT unnest(range(0, (SELECT count(*) FROM nation))) n)")
def enumerate_rows(spark, sf_dir):
    return spark.range(read(spark, sf_dir, "nation").count()).select(F.col("id").alias("a"), (2 * F.col("id")).alias("b"))


@query("SELECT p_brand, round(skewness(p_retailprice), 4) IS NOT NULL s, round(avg(pow(p_retailprice - m, 3)) / pow(var_pop(p_retailprice), 1.5), 6) skew, round(avg(pow(p_retailprice - m, 4)) / pow(var_pop(p_retailprice), 2) - 3, 6) kurt FROM part JOIN (SELECT p_brand, avg(p_retailprice) m FROM part GROUP BY 1) USING (p_brand) GROUP BY 1")
def moments(spark, sf_dir):
    got = read(spark, sf_dir, "part").groupBy("p_brand").agg(e.rounded(F.skewness("p_retailprice"), 6).alias("skew"), e.rounded(F.kurtosis("p_retailprice"), 6).alias("kurt"))
    return got.withColumn("s", F.col("skew").isNotNull())


def queries() -> dict:
    from quiver.plans import exchange, idioms, structures  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
