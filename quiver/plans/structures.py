"""Queries of dictionaries, paths, types, sessions, functions as values and the text
front-end, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiver.functions import expr as e
from quiver.functions import bignum, codec, dates, text, udf
from quiver.operators import cells as c
from quiver.operators import dicts as d
from quiver.plans.catalog import cell, doc, part, query, read
from quiver.plans.session import ERRORS, Console, Namespace, Settings, signal, trap
from quiver.plans.scratch import scratch_dir
from quiver.sources import files, remote

# ---- dictionaries ------------------------------------------------------------------

_NATIONS = "(SELECT n_regionkey, list(n_name ORDER BY n_nationkey) k, list(n_nationkey ORDER BY n_nationkey) v FROM nation GROUP BY 1)"


def _dicts(spark, sf_dir):
    """A dictionary from names to keys for every region."""
    rows = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return rows.select("n_regionkey", d.make(F.transform("l", lambda x: F.struct(x["n_name"].alias("key"), x["n_nationkey"].alias("value")))).alias("d"))


def dictionary(name, build, sql):
    def run(spark, sf_dir):
        return _dicts(spark, sf_dir).select("n_regionkey", build(F.col("d")).alias("r"))

    run.__name__ = name
    query(f"SELECT n_regionkey, {sql} r FROM {_NATIONS}")(run)


dictionary("dict_keys", lambda x: d.keys(x), "k")
dictionary("dict_values", lambda x: d.values(x), "v")
dictionary("dict_unmake", lambda x: F.transform(d.unmake(x), lambda p: F.concat_ws("=", p["key"], p["value"].cast("string"))), "[k[i] || '=' || v[i] FOR i IN range(1, len(k) + 1)]")
dictionary("dict_get", lambda x: d.get(x, "FRANCE", -1), "coalesce(v[list_position(k, 'FRANCE')], -1)")
dictionary("dict_get_all", lambda x: d.get_all(x, F.array(F.lit("CHINA"), F.lit("PERU"))), "[v[list_position(k, 'CHINA')], v[list_position(k, 'PERU')]]")
dictionary("dict_put", lambda x: d.values(d.put(d.put(x, "FRANCE", F.lit(100)), "ATLANTIS", F.lit(7))), "list_append(CASE WHEN list_contains(k, 'FRANCE') THEN [CASE WHEN k[i] = 'FRANCE' THEN 100 ELSE v[i] END FOR i IN range(1, len(k) + 1)] ELSE list_append(v, 100) END, 7)")
dictionary("dict_update", lambda x: d.values(d.update(x, "JAPAN", lambda y: y * 10)), "[CASE WHEN k[i] = 'JAPAN' THEN v[i] * 10 ELSE v[i] END FOR i IN range(1, len(k) + 1)]")
dictionary("dict_each", lambda x: d.values(d.each(lambda y: y + 1, x)), "[y + 1 FOR y IN v]")
dictionary("dict_delete", lambda x: d.keys(d.delete(x, "JAPAN", "BRAZIL")), "list_filter(k, lambda x: x NOT IN ('JAPAN', 'BRAZIL'))")
dictionary("dict_join", lambda x: d.values(d.join(x, F.create_map(F.lit("JAPAN"), F.lit(-1), F.lit("X"), F.lit(-2)))), "list_append(CASE WHEN list_contains(k, 'JAPAN') THEN [CASE WHEN k[i] = 'JAPAN' THEN -1 ELSE v[i] END FOR i IN range(1, len(k) + 1)] ELSE list_append(v, -1) END, -2)")
dictionary("dict_by_value", lambda x: F.transform(d.by_value(d.each(lambda y: -y, x)), lambda p: p["key"]), "list_reverse(k)")


@query("SELECT user_id, kinds, places FROM (SELECT user_id, list(event_type ORDER BY i) kinds, list(p ORDER BY i) places FROM (SELECT user_id, event_type, min(n) i, list(n ORDER BY n) p FROM (SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT n FROM events) GROUP BY 1, 2) GROUP BY 1)")
def dict_group(spark, sf_dir):
    lists = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("l"))
    made = lists.select("user_id", d.group("l").alias("g"))
    return made.select("user_id", d.keys("g").alias("kinds"), d.values("g").alias("places"))


@query("SELECT s_suppkey, s_nationkey::BIGINT + s_suppkey AS total FROM supplier")
def dict_rows(spark, sf_dir):
    rows = d.rows_of(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")), ["s_nationkey", "s_suppkey"])
    return rows.select("s_suppkey", F.aggregate(d.values("dict"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT column_name AS name FROM (DESCRIBE orders)")
def table_keys(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in d.columns(read(spark, sf_dir, "orders"))], "name string")


# ---- types, paths, prototypes ---------------------------------------------------------


@query("SELECT * FROM (VALUES ('doc_id', 8, 1), ('n_chars', 8, 1), ('text', 4, 1)) v(name, code, atom)")
def type_codes(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return spark.createDataFrame([(n, e.type_code(df, n), e.is_atom(df, n)) for n in sorted(df.columns)], "name string, code int, atom int")


@query("SELECT column_name AS name, CASE column_type WHEN 'FLOAT[]' THEN 0 ELSE 1 END AS atom FROM (DESCRIBE embeddings)")
def atoms(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    return spark.createDataFrame([(n, e.is_atom(df, n)) for n in df.columns], "name string, atom int")


cell("path_index", lambda v: c.path(c.reshape(v, 8, 8), 2, 5), "v[22]")
cell("match_cells", lambda v: F.array(c.match(v, c.reverse(c.reverse(v))), c.match(v, c.reverse(v))), "[1, (v = list_reverse(v))::INT]")
cell("set_equal_cells", lambda v: F.array(c.set_equal(v, c.join(v, v)), c.permuted(v, c.reverse(v)), c.permuted(v, c.join(v, v))), "[1, 1, 0]")
cell("inverse_cell", lambda v: c.inverse(c.grade(v)), "[(list_position(list_transform(list_grade_up(v), lambda x: x::INT), i::INT) - 1)::INT FOR i IN range(1, 65)]")
cell("is_sorted_cell", lambda v: F.array(c.is_sorted(v), c.is_sorted(F.array_sort(v))), "[(v = list_sort(v))::INT, 1]")
cell("shape_deep", lambda v: c.shape(F.transform(c.reshape(v, 8, 8), lambda r: c.reshape(r, 4, 2)), 3), "[8, 4, 2]")
cell("take_prototype", lambda v: c.take(3, F.filter(F.col(v), lambda x: x > 0.3), 0.0), "CASE WHEN len(list_filter(v, lambda x: x > 0.3::DOUBLE)) = 0 THEN [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] ELSE [list_filter(v, lambda x: x > 0.3::DOUBLE)[(i % len(list_filter(v, lambda x: x > 0.3::DOUBLE))) + 1] FOR i IN range(0, 3)] END")
cell("first_prototype", lambda v: c.first(F.filter(F.col(v), lambda x: x > 0.3), 0.0), "coalesce(list_filter(v, lambda x: x > 0.3::DOUBLE)[1], 0.0::DOUBLE)")
cell("format_items", lambda v: text.each(F.transform(c.take(64, v), lambda x: F.floor(x * 100)), 7), "[floor(x * 100)::BIGINT::VARCHAR FOR x IN v]")
part("over_range", lambda: c.over(lambda a, b: a + b, c.index("p_size"), F.lit(0)), "(p_size * (p_size - 1) // 2)::INT")


# ---- functions as values ------------------------------------------------------------------


@query("SELECT p_partkey, (p_size * 10 + 3)::INT a, p_size + p_partkey b FROM part")
def lambda_columns(spark, sf_dir):
    one, two = udf.column(lambda x: x * 10 + 3, "int"), udf.column(lambda x, y: x + y, "long", vector=True)
    return read(spark, sf_dir, "part").select("p_partkey", one("p_size").alias("a"), two("p_size", "p_partkey").alias("b"))


@query("SELECT p_partkey, p_size * 7 + 2 v FROM part")
def projection(spark, sf_dir):
    line_ = udf.project(lambda a, b, x: a * x + b, 7, 2)
    return read(spark, sf_dir, "part").select("p_partkey", line_(F.col("p_size")).alias("v"))


@query("SELECT p_partkey, -(1 / p_size) v FROM part")
def verb_train(spark, sf_dir):
    train = udf.compose(lambda x: -x, e.reciprocal)
    return read(spark, sf_dir, "part").select("p_partkey", train(F.col("p_size")).alias("v"))


@query("SELECT n_regionkey, list_reduce(list_prepend(0::BIGINT, list(n_nationkey::BIGINT ORDER BY n_nationkey)), lambda a, b: a * 3 + b) folded FROM nation GROUP BY 1")
def user_fold(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    return udf.fold_groups(n, ["n_regionkey"], "n_nationkey", "n_nationkey", lambda a, b: a * 3 + b, 0, "long")


@query("SELECT n_nationkey AS x, unnest(range(0, n_nationkey))::INT AS i FROM nation")
def user_rows(spark, sf_dir):
    return udf.expand(read(spark, sf_dir, "nation").select("n_nationkey"), lambda r: [(r["n_nationkey"], i) for i in range(r["n_nationkey"])], "x int, i int")


@query("SELECT p_partkey, p_size * 2 + 5 v FROM part")
def saved_function(spark, sf_dir):
    shift, path = 5, f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    files.write_bytes(spark, path, udf.dumps(lambda x: x * 2 + shift))
    again = udf.loads(files.read_slice(spark, path, 0, 1 << 20))
    return read(spark, sf_dir, "part").select("p_partkey", again(F.col("p_size")).alias("v"))


@query("SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN p_size // 2 ELSE 3 * p_size + 1 END)::BIGINT v FROM part")
def memo_column(spark, sf_dir):
    step = udf.memo(lambda n: n // 2 if n % 2 == 0 else 3 * n + 1)
    return read(spark, sf_dir, "part").select("p_partkey", udf.column(lambda x: step(x), "long")("p_size").alias("v"))


# ---- names, watches, settings, errors -----------------------------------------------------------


@query("SELECT s_suppkey pos, CASE WHEN s_suppkey = 3 THEN 0.0::DOUBLE ELSE s_acctbal + 1 END v FROM supplier")
def assign_and_amend(spark, sf_dir):
    """Assign, modify in place, assign at an index; the view of the name is read."""
    ns = Namespace(spark, "q_assign")
    ns.assign("a", read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_acctbal").alias("v")))
    ns.amend("a", lambda x, by: x.withColumn("v", F.col("v") + by), 1)
    ns.amend_at("a", spark.createDataFrame([(3, 0.0)], "pos long, v double"), "v")
    return spark.table("q_assign_a")


@query("SELECT n_nationkey k, n_nationkey * 2 v FROM nation")
def watch_chain(spark, sf_dir):
    """A watcher assigns another name, whose value follows the first."""
    ns = Namespace(spark, "q_watch")
    ns.watch("a", lambda x: ns.assign("b.c", x.withColumn("v", F.col("k") * 2)))
    ns.assign("a", read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")))
    return ns.get("b.c")


@query("SELECT * FROM (VALUES ('a', 'table'), ('b.c', 'int')) v(name, kind)")
def names_listed(spark, sf_dir):
    ns = Namespace(spark, "q_names")
    ns.assign("a", read(spark, sf_dir, "nation"))
    ns.assign("b.c", 5)
    ns.assign("gone", 1)
    ns.delete("gone")
    return spark.createDataFrame(ns.verbose(), "name string, kind string")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in sorted(ERRORS)) + ") v(code)")
def error_names(spark, sf_dir):
    return spark.createDataFrame([(trap(signal, n)[1],) for n in sorted(ERRORS)], "code string")


@query("SELECT * FROM (VALUES ('reserved', 1), ('value', 1), ('length', 1), ('fine', 0)) v(name, failed)")
def trapped(spark, sf_dir):
    ns, n = Namespace(None), read(spark, sf_dir, "nation")
    odd = lambda: n.select(c.each2(lambda x, y: x + y, F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).collect()
    done = {"reserved": trap(ns.assign, "sin", 1), "value": trap(ns.get, "nobody"), "length": trap(odd), "fine": trap(n.count)}
    return spark.createDataFrame([(k, int(v[0])) for k, v in done.items()], "name string, failed int")


@query("SELECT p_partkey, regexp_replace(printf('%.3f', p_size / 8), '\\.?0+$', '') v FROM part WHERE p_size < 80")
def print_precision(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_size < 80").select("p_partkey", Settings(digits=6).shown(F.col("p_size") / 8).alias("v"))


@query("SELECT p_partkey, CASE WHEN abs(p_size - 25) < 3 THEN '0' ELSE (p_size - 25)::VARCHAR END v FROM part")
def zero_clamp(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", Settings(zero=3.0).shown(F.col("p_size") - 25.0).alias("v"))


@query("SELECT * FROM (VALUES ('d', 'a'), ('e', '0'), ('p', '3'), ('v', 'a.b'), ('zc', '0.5')) v(command, answer)")
def system_commands(spark, sf_dir):
    ns = Namespace(spark, "q_console")
    ns.assign("a.b", 1)
    ns.assign("other", 2)
    console = Console(ns)
    said = {w: console.run(f"\\{w} {x}".rstrip()) for w, x in (("p", "3"), ("zc", "0.5"), ("e", "0"), ("d", "a"), ("v", ""))}
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in sorted(said.items())], "command string, answer string")


@query("SELECT * FROM (VALUES ('ask', 42), ('error', 1), ('rows', (SELECT count(*)::INT FROM nation)), ('sent', 3)) v(name, x)")
def messages(spark, sf_dir):
    """A listener and its client: answers, errors, one-way messages, a table's rows."""
    got = []
    read(spark, sf_dir, "nation").createOrReplaceGlobalTempView("q_messages")
    server = remote.Listener({"add": lambda a, b: a + b, "keep": lambda x: got.append(x), "kept": lambda: sum(got)} | remote.table_handlers(spark))
    handle = remote.connect(*server.address)
    try:
        for x in (1, 2):
            handle.send("keep", x)
        sent = handle.ask("kept")  # messages of a connection are handled in order
        rows = [("ask", handle.ask("add", 40, 2)), ("error", trap(handle.ask, "nobody")[0]), ("rows", len(handle.ask("sql", "SELECT * FROM global_temp.q_messages"))), ("sent", sent)]
    finally:
        handle.close()
        server.close()
    return spark.createDataFrame(rows, "name string, x int")


# ---- codecs, native code, large numbers, the clock -------------------------------------------------


doc("lzw_round", lambda: F.array(F.md5(codec.unlzw(codec.lzw("text"))), (F.octet_length(codec.lzw("source")) > 0).cast("string")), "[md5(text), 'true']")
cell("printable", lambda v: codec.printable(F.transform(F.transform(F.col(v), lambda x: F.floor(x * 10).cast("int")), lambda x: x), "array<int>"), "list_aggregate([floor(x * 10)::INT::VARCHAR FOR x IN v], 'string_agg', ' ')")
part("printable_text", lambda: codec.printable("p_type", "string"), "'\"' || p_type || '\"'")
part("printable_nested", lambda: codec.printable(F.array(F.array(F.col("p_size"), F.lit(1)), F.array(F.col("p_size"))), "array<array<int>>"), "'(' || p_size || ' 1;,' || p_size || ')'")
cell("path_all", lambda v: c.path(c.reshape(v, 8, 8), None, 5), "[v[i * 8 + 6] FOR i IN range(0, 8)]")
part("native_cbrt", lambda: e.rounded(udf.native("libm.so.6", "cbrt", ["double"], "double")(F.col("p_size").cast("double")), 9), "round(cbrt(p_size), 9)")
part("big_factorial", lambda: bignum.factorial(F.col("p_size") % 30), "factorial(p_size % 30)::VARCHAR")
part("big_product", lambda: bignum.remainder(bignum.multiply(bignum.power(F.lit(10), F.lit(40)), "p_partkey"), F.lit(97)), "((10000000000::HUGEINT * 10000000000 % 97) * (10000000000::HUGEINT * 10000000000 % 97) * p_partkey % 97)::VARCHAR")


@query("SELECT true AS same")
def clock_now(spark, sf_dir):
    """The clock of the query against the driver's, a day apart at most."""
    import datetime

    day = spark.range(1).select(dates.now().alias("n")).first().n.day
    gap = abs((datetime.datetime.strptime(str(day), "%Y%m%d") - datetime.datetime.now()).days)
    return spark.createDataFrame([(gap <= 1,)], "same boolean")


# ---- the text front-end over lists ---------------------------------------------------------------


def noted(name, text_, sql, digits=None):
    def run(spark, sf_dir):
        from quiver.plans import notation

        v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        return notation.select(v, vec_id="vec_id", r=text_)

    run.__name__ = name
    query(f"SELECT vec_id, {sql} r FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)")(run)


noted("notation_each", "{x*x}'v", "[x * x FOR x IN v]")
noted("notation_max", "|/v", "list_max(v)")
noted("notation_sorted", "v@<v", "list_sort(v)")
noted("notation_positive", "&v>0.2", "list_filter([CASE WHEN v[i + 1] > 0.2::DOUBLE THEN i::INT END FOR i IN range(0, 64)], lambda x: x IS NOT NULL)")
noted("notation_reshape", "8 8#v", "[v[i * 8 + 1:i * 8 + 8] FOR i IN range(0, 8)]")
noted("notation_flip", "+8 8#v", "[[v[i * 8 + j + 1] FOR i IN range(0, 8)] FOR j IN range(0, 8)]")
noted("notation_maxima", "|/'8 8#v", "[list_max(v[i * 8 + 1:i * 8 + 8]) FOR i IN range(0, 8)]")
noted("notation_index", "(8 8#v)[;3]", "[v[i * 8 + 4] FOR i IN range(0, 8)]")
noted("notation_lambda", "{[a;b]d:a-b;d*d}'[v;|v]", "[(v[i] - v[65 - i]) * (v[i] - v[65 - i]) FOR i IN range(1, 65)]")
noted("notation_condition", ":[v[0]>v[1];1;v[0]<v[1];-1;0]", "CASE WHEN v[1] > v[2] THEN 1 WHEN v[1] < v[2] THEN -1 ELSE 0 END")
noted("notation_right", "2 */2#v", "[2 * v[1], 2 * v[2]]")
