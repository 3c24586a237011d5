"""Vectors as table columns: filters, groups, statistics, windows, sorts, lookups
and set operations, and vectors with explicit positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quiver.functions.expr import col
from quiver.plans.scratch import discard, materialize

# ---- positions ---------------------------------------------------------------


def ranged(df: DataFrame, order_by: list, parts: int | None = None) -> DataFrame:
    """``df`` sorted over ranges, written once: ``__range`` numbers a row's range and
    ``__n`` its place there.  Ties keep the order they are read in, which also
    cuts a frequent key; nulls come where the keys put them, first by default."""
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*order_by, "__read"]
    sorted_ = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__read")
    # the number of a row holds its partition above 33 bits and its place there below
    rows = materialize(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    return rows.withColumns({"__range": F.shiftright("__at", 33).cast("int"), "__n": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def before_range(rows: DataFrame, total: Column, kind: str) -> DataFrame:
    """(__range, __before): ``total`` over the rows of all earlier ranges.  One row a
    range reaches the driver."""
    sums = sorted(tuple(r) for r in rows.groupBy("__range").agg(total).collect())
    out, so_far = [], 0 if kind == "long" else 0.0
    for r, x in sums:
        out.append((r, so_far))
        so_far += x or 0
    return F.broadcast(rows.sparkSession.createDataFrame(out, f"__range int, __before {kind}"))


def with_pos(df: DataFrame, order_by: list, pos: str = "pos", parts: int | None = None) -> DataFrame:
    """Positions 0, 1, ... by ``order_by`` (names or sort keys), ties as they are
    read: ranges are sorted on their own and shifted by the rows before them."""
    rows = ranged(df, order_by, parts)
    return rows.join(before_range(rows, F.count("*"), "long"), "__range").withColumn(pos, F.col("__n") + F.col("__before")).drop("__range", "__n", "__before")


def global_scan(df: DataFrame, value: str, order_by: list, out: str = "running", parts: int | None = None) -> DataFrame:
    """Running sum over the whole table in order: each range sums its own rows,
    and the sums of earlier ranges, a row a range, are added.  Null values add
    nothing; before the first value the sum is null."""
    rows = ranged(df, order_by, parts)
    kind = "long" if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else "double"
    offsets = before_range(rows, F.sum(value), kind)
    inside = Window.partitionBy("__range").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("__s", F.sum(value).over(inside)).join(offsets, "__range")
    total = F.when(F.col("__s").isNotNull() | (F.col("__before") != 0), F.coalesce("__s", F.lit(0)) + F.col("__before"))
    return scanned.withColumn(out, total).drop("__range", "__n", "__s", "__before")


def take(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """First n positions, last for negative n, starting over past the end; an empty
    table gives none."""
    size = df.agg(F.count("*").alias("__size"))
    w = abs(n)
    first = F.col(pos) if n >= 0 else F.pmod(F.col(pos) + w, F.col("__size"))
    turns = F.sequence(F.lit(0), F.floor((F.lit(w - 1) - F.col("__first")) / F.col("__size")))
    rows = df.crossJoin(F.broadcast(size)).withColumn("__first", first).where(F.col("__first") < w)  # one row
    return rows.withColumn("__turn", F.explode(turns)).withColumn(pos, F.col("__first") + F.col("__turn") * F.col("__size")).drop("__size", "__first", "__turn")


def drop(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) >= n).withColumn(pos, F.col(pos) - n)


def reverse(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    return df.withColumn(pos, F.lit(size - 1) - F.col(pos))


def rotate(df: DataFrame, n: int, size: int, pos: str = "pos") -> DataFrame:
    return df.withColumn(pos, F.pmod(F.col(pos) - n, F.lit(size)))


def reshape_rows(df: DataFrame, width: int, value: str, pos: str = "pos") -> DataFrame:
    """Rows of ``width`` values in order; the last may be shorter."""
    cells = df.groupBy(F.floor(F.col(pos) / width).alias("row")).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("c"))
    return cells.select("row", F.transform("c", lambda x: x[value]).alias("items"))


def cut_rows(df: DataFrame, points: list[int], value: str, pos: str = "pos") -> DataFrame:
    """Pieces starting at ascending positions."""
    piece = reduce(lambda c, p: c + (F.col(pos) >= p).cast("int"), points, F.lit(-1))
    cells = df.withColumn("piece", piece).where("piece >= 0").groupBy("piece").agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("c"))
    return cells.select("piece", F.transform("c", lambda x: x[value]).alias("items"))


def amend(df: DataFrame, updates: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """Values at the updates' positions replaced."""
    new = updates.select(pos, F.col(value).alias("__new"))
    return df.join(new, pos, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def insert_after(df: DataFrame, new: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """``new`` rows (after, turn, value) behind the positions they name, -1 being ahead of
    all, in order of ``turn``; positions are numbered again."""
    old = df.select(F.col(pos).cast("long").alias("__p"), F.lit(0).alias("__k"), F.lit(0).alias("__o"), value)
    rows = old.union(new.select(F.col("after").cast("long"), F.lit(1), F.col("turn").cast("int"), value))
    return with_pos(rows, ["__p", "__k", "__o"], pos).select(pos, value)


def delete_at(df: DataFrame, positions: DataFrame, pos: str = "pos") -> DataFrame:
    return df.join(positions.select(pos), pos, "left_anti")


# ---- groups and statistics ----------------------------------------------------


def over(df: DataFrame, **folds: Column) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in folds.items()])


def group(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Positions of each key with its first one (order of first appearance)."""
    return df.groupBy(key).agg(F.min(pos).alias("first"), F.sort_array(F.collect_list(pos)).alias("positions"))


def group_agg(df: DataFrame, keys: list[str], **folds: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def distinct_first(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(pos).alias("first"))


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def ordered_fold(df: DataFrame, keys: list[str], value: str, pos: str, start: Column, f) -> DataFrame:
    """Fold of a group's values in order, for folds that do not associate; a
    group's values meet in one array."""
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("__l"))
    return lists.select(*keys, F.aggregate(F.transform("__l", lambda x: x[value]), start, f).alias("folded"))


# ---- windows ------------------------------------------------------------------


def ordered(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def scan(agg, value, by: list[str], order: list) -> Column:
    """Running aggregate."""
    return agg(col(value)).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))


def each_prior(f, value, by: list[str], order: list) -> Column:
    """f(value, the one before); null for the first."""
    prior = F.lag(col(value)).over(ordered(by, order))
    return F.when(prior.isNotNull(), f(col(value), prior))


def slide(df: DataFrame, f, value: str, by: list[str], order: list, step: int = 1, out: str = "slid") -> DataFrame:
    """f of neighbours every ``step`` rows; a pair cut off at the end goes."""
    w = ordered(by, order)
    nxt, n = F.lead(value).over(w), F.row_number().over(w) - 1
    pair = f(nxt, F.col(value)) if step < 0 else f(F.col(value), nxt)
    return df.withColumn("__n", n).withColumn("__x", nxt).withColumn(out, pair).where((F.col("__n") % abs(step) == 0) & F.col("__x").isNotNull()).drop("__n", "__x")


def moving(agg, value, n: int, by: list[str], order: list) -> Column:
    return agg(col(value)).over(ordered(by, order).rowsBetween(-(n - 1), 0))


def segments(flag: Column, by: list[str], order: list) -> Column:
    """Number of marked rows up to each row: the segment it lies in."""
    return F.sum(flag.cast("int")).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))


def runs(df: DataFrame, value: str, by: list[str], order: list) -> DataFrame:
    """Runs of equal neighbours with their lengths."""
    w = ordered(by, order)
    mark = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    tagged = df.withColumn("__m", mark).withColumn("run", F.sum(F.col("__m").cast("int")).over(w))
    return tagged.groupBy(*by, "run", value).agg(F.count("*").alias("length"))


# ---- order ----------------------------------------------------------------------


def grade(df: DataFrame, keys: list, pos: str, out: str = "rank") -> DataFrame:
    """Row ranks by the keys, ties by position."""
    return with_pos(df, [*keys, pos], out)


def inverse(df: DataFrame, rank: str = "rank", pos: str = "pos") -> DataFrame:
    """The inverse of a permutation held as (pos, rank) rows."""
    return df.select(F.col(rank).alias(pos), F.col(pos).alias(rank))


def is_sorted(df: DataFrame, key: str, order_by: list) -> DataFrame:
    """One row, ``sorted``: whether ``key`` never falls in the order of ``order_by``;
    range by range, and across the ends of ranges."""
    rows = ranged(df.select(key, *[o for o in order_by if o != key]), order_by)
    lag = F.lag(key).over(Window.partitionBy("__range").orderBy("__n"))
    falls = rows.withColumn("__falls", F.coalesce(lag > F.col(key), F.lit(False)))
    ends = falls.groupBy("__range").agg(F.bool_or("__falls"), F.min_by(key, "__n"), F.max_by(key, "__n")).collect()  # one row a range
    ends = sorted(tuple(r) for r in ends)
    fine = not any(f for _, f, *_ in ends) and all(a is None or b is None or a <= b for (*_, a), (_, _, b, _) in zip(ends, ends[1:]))
    return df.sparkSession.createDataFrame([(fine,)], "sorted boolean")


def top(df: DataFrame, n: int, *keys) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def nan_first(c) -> list[Column]:
    """Ascending keys under which NaN is least."""
    return [F.isnan(col(c)).desc(), col(c).asc()]


# ---- lookups and sets -------------------------------------------------------------


def find(x: DataFrame, a: DataFrame, key_x: str, key_a: str, pos: str, out: str = "found") -> DataFrame:
    """Position of each key's first occurrence in ``a``, its count where absent."""
    firsts = a.groupBy(F.col(key_a).alias("__k")).agg(F.min(pos).alias("__p"))
    size = a.agg(F.count("*").alias("__n"))
    joined = x.join(firsts, x[key_x] == F.col("__k"), "left").crossJoin(F.broadcast(size))  # one row
    return joined.withColumn(out, F.coalesce("__p", "__n")).drop("__k", "__p", "__n")


def gather(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return fact.join(dim, key, how)


def members(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Rows of a with a partner in b, repeats kept."""
    return a.join(b, on, "left_semi")


def without(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_anti")


#: Rows that one side of a table of all pairs may have.
PAIRS = 1_000_000


def pairs(a: DataFrame, b: DataFrame, f: Column, out: str = "value") -> DataFrame:
    """f over every pair: the outer table of a verb.  ``b`` is the short operand;
    more than ``PAIRS`` rows of it are a wsfull error."""
    from quiver.plans.session import signal

    if b.limit(PAIRS + 1).count() > PAIRS:
        signal("wsfull", f"more than {PAIRS} rows")
    return a.crossJoin(b).withColumn(out, f)


def zip_rows(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of equal positions side by side; unequal counts are a length error."""
    got = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), pos, "full")
    bad = F.col("__a").isNull() | F.col("__b").isNull()
    checked = F.when(bad, F.raise_error(F.lit("length")).cast("long")).otherwise(F.col(pos))
    return got.withColumn(pos, checked).drop("__a", "__b")


def classify(df: DataFrame, value: str, cuts: list[float], out: str = "cell") -> DataFrame:
    """How many of a few sorted cuts lie below the value."""
    c = F.array(*[F.lit(float(x)) for x in sorted(cuts)])
    return df.withColumn(out, F.size(F.filter(c, lambda e: e < F.col(value))))


def bin_below(values: DataFrame, cuts: DataFrame, value: str, cut: str, by: list[str] | None = None, out: str = "cell", hot: bool = False) -> DataFrame:
    """How many cuts of the same ``by`` group lie below each value: values and
    cuts merged in order, cuts counted as they pass.  Ties leave equal cuts out.
    Without ``by`` the order is cut into ranges; with it, a group is one window, or
    with ``hot`` groups are cut into ranges too and each gives up what was counted
    before it, a row a group."""
    by = by or []
    v = values.select(*by, F.col(value).alias("__x"), F.lit(0).alias("__cut"), F.struct(*values.columns).alias("__row"))
    kind = v.schema["__row"].dataType
    c = cuts.select(*by, F.col(cut).alias("__x"), F.lit(1).alias("__cut"), F.lit(None).cast(kind).alias("__row"))
    both = v.unionByName(c)
    if by and hot:
        counted = global_scan(both, "__cut", [*by, "__x", "__cut"], "__all")
        counted = materialize(counted)  # read twice
        keys = {b: f"__by{i}" for i, b in enumerate(by)}
        first = counted.groupBy(*[F.col(b).alias(k) for b, k in keys.items()]).agg(F.min(F.col("__all") - F.col("__cut")).alias("__gone"))
        same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(k)) for b, k in keys.items()])
        counted = counted.join(first, same).withColumn(out, F.col("__all") - F.col("__gone"))
    elif by:
        w = Window.partitionBy(*by).orderBy("__x", "__cut").rowsBetween(Window.unboundedPreceding, 0)
        counted = both.withColumn(out, F.sum("__cut").over(w))
    else:
        counted = global_scan(both, "__cut", ["__x", "__cut"], out)
    return counted.where("__cut = 0").select("__row.*", out)


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Transitive closure of (a, b): paths double each round until none is new, and
    each round is one job, a written table counted as it is written; an error if
    ``rounds`` doublings do not end it."""

    def written(df):
        seen = Observation()
        out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    paths, n = written(edges.select("a", "b").distinct())
    for _ in range(rounds):
        step = paths.select("a", F.col("b").alias("m")).join(paths.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        longer, now = written(paths.union(step).distinct())
        discard(paths)
        paths = longer
        if now == n:
            return paths
        n = now
    raise RuntimeError(f"closure: not reached after {rounds} rounds")


def shortest(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b, hops) of every pair that edges (a, b) connect, hops the fewest.  Paths
    double each round, as in :func:`closure`, and each round is one job."""

    def written(df):
        seen = Observation()
        out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("hops").alias("s")))
        return out, (seen.get["n"], seen.get["s"])

    paths, size = written(edges.select("a", "b").distinct().withColumn("hops", F.lit(1)))
    for _ in range(rounds):
        on = paths.select(F.col("a").alias("m"), "b", F.col("hops").alias("more"))
        step = paths.select("a", F.col("b").alias("m"), "hops").join(on, "m").select("a", "b", (F.col("hops") + F.col("more")).alias("hops"))
        shorter, now = written(paths.union(step).groupBy("a", "b").agg(F.min("hops").alias("hops")))
        discard(paths)
        paths = shorter
        if now == size:
            return paths
        size = now
    raise RuntimeError(f"shortest: not reached after {rounds} rounds")


def fixpoint(f, x: DataFrame, same, rounds: int = 64) -> DataFrame:
    """f applied until ``same(new, old)`` holds, or it is back where it began;
    an error if neither comes about in ``rounds`` rounds."""
    start = x
    for _ in range(rounds):
        new = f(x)
        if same(new, x) or same(new, start):
            return new
        x = new
    raise RuntimeError(f"fixpoint: not reached after {rounds} rounds")


def steps(f, x: DataFrame, same, rounds: int = 64) -> list[DataFrame]:
    """Every step of :func:`fixpoint`, the first value first."""
    out = [x]
    for _ in range(rounds):
        new = f(out[-1])
        if same(new, out[-1]) or same(new, out[0]):
            return out
        out.append(new)
    raise RuntimeError(f"steps: no end after {rounds} rounds")


# ---- tests of whole vectors ---------------------------------------------------------


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))


def match(a: DataFrame, b: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """One row, ``match``: whether two positioned vectors agree item by item."""
    l, r = a.select(pos, F.col(value).alias("__x"), F.lit(1).alias("__a")), b.select(pos, F.col(value).alias("__y"), F.lit(1).alias("__b"))
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__x").eqNullSafe(F.col("__y"))
    return l.join(r, pos, "full").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("match"))


def set_equal(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row, ``equal``: whether two vectors hold the same items, however often."""
    l, r = (x.select(F.col(value).alias("__v")).distinct().withColumn(n, F.lit(1)) for x, n in ((a, "__a"), (b, "__b")))
    both = l.join(r.withColumnRenamed("__v", "__w"), F.col("__v").eqNullSafe(F.col("__w")), "full")
    return both.agg(F.coalesce(F.bool_and(F.col("__a").isNotNull() & F.col("__b").isNotNull()), F.lit(True)).alias("equal"))


def permuted(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row, ``permutation``: whether one vector is the other in another order."""
    l, r = _counts(a, value), _counts(b, value).select(F.col("__v").alias("__w"), F.col("__n").alias("__m"))
    both = l.join(r, F.col("__v").eqNullSafe(F.col("__w")), "full")
    return both.agg(F.coalesce(F.bool_and(F.col("__n").eqNullSafe(F.col("__m"))), F.lit(True)).alias("permutation"))
