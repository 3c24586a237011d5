"""Vectors held in array cells: structure, lookup, folds and scans.

Positions count from 0.  Lists are conformed explicitly: a length mismatch is an
error rather than a null pad.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.expr import col


def let(value, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def bound(a, use) -> Column:
    """``use`` of a list: of the column where a name is given, else of an expression
    that is worked out once and not again for each item."""
    return use(col(a)) if isinstance(a, str) else let(col(a), use)


def pieces(a: Column) -> Column:
    """A list in parts of about the root of its length."""
    n = F.size(a)
    width = F.greatest(F.lit(8), F.ceil(F.sqrt(n))).cast("int")
    return F.transform(index(F.ceil(n / width)), lambda i: F.slice(a, i * width + 1, width))


def running(values, op) -> Column:
    """Running ``op``, which must associate, over a list of integers; parts of the
    list are scanned on their own, so that a long list is not copied for each item."""

    def scan_(a: Column) -> Column:
        def step(acc, x):
            return F.concat(acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x)))

        return F.aggregate(a, F.array().cast("array<int>"), step)

    def joined(parts: Column) -> Column:
        ends = scan_(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: F.coalesce(op(F.get(e, i - 1), x), x)))))

    return let(col(values), lambda v: let(F.transform(pieces(v), scan_), joined))


def index(n) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(col(n) > 0, F.sequence(F.lit(0), (col(n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def first(a, default=None) -> Column:
    out = F.get(col(a), F.lit(0))
    return out if default is None else F.coalesce(out, F.lit(default))


def count(a) -> Column:
    return F.size(col(a))


def shape(m, depth: int = 2) -> Column:
    """Dimensions of a regular list nested ``depth`` deep; those above the first
    ragged level only."""
    m = col(m)
    out, level, even = F.array(F.size(m)), m, F.lit(True)

    def regular(rows, width):
        return F.coalesce(F.forall(rows, lambda r: F.size(r) == width), F.lit(False))

    for _ in range(depth - 1):
        width = F.size(F.get(level, 0))
        even = even & regular(level, width)
        out = F.when(even, F.concat(out, F.array(width))).otherwise(out)
        level = F.flatten(level)
    return out


def enlist(a) -> Column:
    return F.array(col(a))


def reverse(a) -> Column:
    return F.reverse(col(a))


def take(n: int, a, default=None) -> Column:
    """First n items, or last for negative n, starting over past the end; of an
    empty list, ``default`` n times (null unless given)."""
    w = abs(n)
    if not n:
        return F.slice(col(a), 1, 0)

    def items(v):
        size = F.size(v)
        from_ = F.lit(0) if n > 0 else F.pmod(size * w - w, size)
        out = F.transform(index(F.lit(w)), lambda i: F.get(v, F.pmod(i + from_, size)))
        return out if default is None else F.when(size == 0, F.array_repeat(F.lit(default), w)).otherwise(out)

    return bound(a, items)


def drop(n: int, a) -> Column:
    a = col(a)
    left = F.greatest(F.size(a) - abs(n), F.lit(0))
    return F.slice(a, F.lit(n + 1), left) if n >= 0 else F.slice(a, F.lit(1), left)


def rotate(n: int, a) -> Column:
    a = col(a)
    k = F.pmod(F.lit(n), F.size(a))
    return F.when(F.size(a) > 0, F.concat(F.slice(a, k + 1, F.size(a) - k), F.slice(a, F.lit(1), k))).otherwise(a)


def join(a, b) -> Column:
    return F.concat(col(a), col(b))


def raze(a) -> Column:
    return F.flatten(col(a))


def cut(points: list[int], a) -> Column:
    """Pieces that start at ascending positions; what lies before the first goes."""
    a = col(a)
    stops = [F.lit(p) for p in points[1:]] + [F.size(a)]
    return F.array(*[F.slice(a, F.lit(p + 1), F.greatest(s - p, F.lit(0))) for p, s in zip(points, stops)])


def reshape(a, rows: int | None, width: int | None) -> Column:
    """rows x width, starting over past the end; without rows, rows of ``width``
    with a shorter last one; without width, ``rows`` even parts."""
    def shaped(v):
        n = F.size(v)
        if rows is None:
            return F.transform(index(F.ceil(n / width)), lambda i: F.slice(v, i * width + 1, F.lit(width)))
        if width is None:
            edge = lambda i: F.floor(i * n / rows).cast("int")
            return F.transform(index(F.lit(rows)), lambda i: F.slice(v, edge(i) + 1, edge(i + 1) - edge(i)))
        return F.transform(index(F.lit(rows)), lambda i: F.transform(index(F.lit(width)), lambda j: F.get(v, (i * width + j) % n)))

    return bound(a, shaped)


def flip(m) -> Column:
    """Transpose of a regular matrix; ragged rows are a length error."""
    def turned(m):
        width = F.size(F.get(m, 0))
        even = F.forall(m, lambda r: F.size(r) == width)
        out = F.transform(index(width), lambda j: F.transform(m, lambda r: F.get(r, j)))
        return F.when(even, out).otherwise(F.raise_error(F.lit("length")))

    return bound(m, turned)


def at(a, i) -> Column:
    """Item, or null out of range."""
    return F.get(col(a), col(i))


def at_strict(a, i) -> Column:
    a, i = col(a), col(i)
    ok = (i >= 0) & (i < F.size(a))
    return F.when(ok, F.get(a, i)).otherwise(F.raise_error(F.lit("index")))


def gather(a, idx) -> Column:
    return bound(a, lambda v: F.transform(col(idx), lambda i: F.get(v, i)))


def where(flags) -> Column:
    """Position i, repeated flags[i] times."""
    a = col(flags)
    return F.flatten(F.transform(a, lambda x, i: F.array_repeat(i, x.cast("int"))))


def amend(a, positions: list[int], fn: Callable[[Column], Column]) -> Column:
    """Items at the positions replaced by ``fn`` of them."""
    return F.transform(col(a), lambda x, i: F.when(i.isin(*positions), fn(x)).otherwise(x))


def amend_path(m, row: int, column: int, fn: Callable[[Column], Column]) -> Column:
    return F.transform(col(m), lambda r, i: F.when(i == row, F.transform(r, lambda x, j: F.when(j == column, fn(x)).otherwise(x))).otherwise(r))


def delete_at(a, positions: list[int]) -> Column:
    return F.filter(col(a), lambda x, i: ~i.isin(*positions))


def find(a, x) -> Column:
    """First position of x, or the count of a where it is absent."""
    p = F.array_position(col(a), col(x))
    return F.when(p == 0, F.size(col(a))).otherwise(p - 1).cast("long")


def is_in(x, a) -> Column:
    return F.array_contains(col(a), col(x)).cast("int")


def members(a, b) -> Column:
    return bound(b, lambda v: F.transform(col(a), lambda x: F.array_contains(v, x).cast("int")))


def without(a, b) -> Column:
    """Items of a that are not in b, repeats kept."""
    return bound(b, lambda v: F.filter(col(a), lambda x: ~F.array_contains(v, x)))


def distinct(a) -> Column:
    return F.array_distinct(col(a))


def group(a) -> Column:
    """Position lists of the distinct items, in order of first appearance."""
    def grouped(v):
        places = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return let(places, lambda ps: F.transform(F.array_distinct(v), lambda u: F.transform(F.filter(ps, lambda p: p["x"] == u), lambda p: p["i"])))

    return bound(a, grouped)


def grade(a, up: bool = True) -> Column:
    """Positions that sort the list; ties keep their order."""
    pairs = F.transform(col(a), lambda x, i: F.struct((x if up else -x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def below(sorted_, x) -> Column:
    """How many items of a sorted list are below x."""
    return F.size(F.filter(col(sorted_), lambda e: e < col(x)))


def each(f: Callable[[Column], Column], a) -> Column:
    return F.transform(col(a), f)


def each2(f: Callable[[Column, Column], Column], a, b) -> Column:
    """Item by item; unequal lengths are a length error."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("length")))


def each_right(f, a, b) -> Column:
    return bound(a, lambda v: F.transform(col(b), lambda y: f(v, y)))


def each_left(f, a, b) -> Column:
    return bound(b, lambda v: F.transform(col(a), lambda x: f(x, v)))


def table_of(f, a, b) -> Column:
    """f of every pair, a row for each item of a."""
    return bound(b, lambda v: F.transform(col(a), lambda x: F.transform(v, lambda y: f(x, y))))


def over(f, a, start=None) -> Column:
    """Fold from the left; without a start from the first item (null if empty)."""
    a = col(a)
    if start is not None:
        return F.aggregate(a, col(start), f)
    rest = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.when(F.size(a) > 0, F.aggregate(rest, F.get(a, 0), f))


def scan(f, a, start=None) -> Column:
    """Every step of the fold; part by part, so that a long list is not copied for
    each item."""
    a = col(a)
    if start is None:
        rest = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
        seed = F.get(a, 0)
    else:
        rest, seed = a, col(start)

    def part(last, xs):  # the steps of xs from ``last`` on
        got = F.aggregate(xs, F.array(last), lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))))
        return F.slice(got, F.lit(2), F.size(xs))

    def whole(xs):
        end = lambda acc: F.element_at(F.element_at(acc, -1), -1)
        return F.flatten(F.aggregate(pieces(xs), F.array(F.array(seed)), lambda acc, p: F.concat(acc, F.array(part(end(acc), p)))))

    out = let(rest, whole)
    return F.when(F.size(a) > 0, out).otherwise(F.slice(a, 1, 0)) if start is None else out


def fold_many(f, start, *lists) -> Column:
    """Seeded fold over lists in step: f(acc, item of each list)."""
    names = [f"c{i}" for i in range(len(lists))]
    zipped = F.arrays_zip(*[col(x).alias(n) for x, n in zip(lists, names)])
    return F.aggregate(zipped, col(start), lambda acc, x: f(acc, *[x[n] for n in names]))


def do(n: int, f, x) -> Column:
    """f applied n times."""
    out = col(x)
    for _ in range(n):
        out = f(out)
    return out


def do_fold(n: int, f, x) -> Column:
    """f applied n times as one fold, for a large n."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), col(x), lambda acc, _: f(acc))


def while_(cond, f, x, most: int = 64) -> Column:
    """f while cond holds; an error if it still holds after ``most`` times."""
    unfinished = F.raise_error(F.lit(f"while_: the condition still holds after {most} rounds"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), col(x), lambda acc, _: F.when(cond(acc), f(acc)).otherwise(acc),
        lambda acc: F.when(cond(acc), unfinished).otherwise(acc),
    )


def do_scan(n: int, f, x) -> Column:
    """x and every one of n applications of f."""
    return F.aggregate(index(F.lit(n)), F.array(col(x)), lambda acc, _: F.concat(acc, F.array(f(F.element_at(acc, -1)))))


def while_scan(cond, f, x, most: int = 64) -> Column:
    """x and every application of f while ``cond`` holds of the last; an error if it
    still holds after ``most``."""
    unfinished = F.raise_error(F.lit(f"while_scan: the condition still holds after {most} rounds"))
    more = lambda acc: F.concat(acc, F.array(f(F.element_at(acc, -1))))
    return F.aggregate(
        index(F.lit(most)), F.array(col(x)), lambda acc, _: F.when(cond(F.element_at(acc, -1)), more(acc)).otherwise(acc),
        lambda acc: F.when(cond(F.element_at(acc, -1)), unfinished).otherwise(acc),
    )


def converge(f, x, most: int = 64) -> Column:
    """f until it changes nothing or is back at the start; an error after ``most``."""
    return F.element_at(converge_scan(f, x, most), -1)


def converge_scan(f, x, most: int = 64) -> Column:
    """x and every new value on the way to the fixed point."""
    x = col(x)
    over_ = lambda acc: f(F.element_at(acc, -1)).eqNullSafe(F.element_at(acc, -1)) | f(F.element_at(acc, -1)).eqNullSafe(F.get(acc, 0))
    unfinished = F.raise_error(F.lit(f"converge: not reached after {most} rounds"))
    return F.aggregate(
        index(F.lit(most)), F.array(x), lambda acc, _: F.when(over_(acc), acc).otherwise(F.concat(acc, F.array(f(F.element_at(acc, -1))))),
        lambda acc: F.when(over_(acc), acc).otherwise(unfinished),
    )


def each_n(f, *lists) -> Column:
    """f of the items of several lists in step; unequal lengths are a length error."""
    cols = [col(x) for x in lists]
    names = [f"c{i}" for i in range(len(cols))]
    even = F.lit(True)
    for c in cols[1:]:
        even = even & (F.size(c) == F.size(cols[0]))
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, names)])
    return F.when(even, F.transform(zipped, lambda x: f(*[x[n] for n in names]))).otherwise(F.raise_error(F.lit("length")))


def match(a, b) -> Column:
    """1 where two lists agree in length, items and nulls."""
    return col(a).eqNullSafe(col(b)).cast("int")


def set_equal(a, b) -> Column:
    """1 where two lists hold the same items, however often."""
    return ((F.size(F.array_except(col(a), col(b))) == 0) & (F.size(F.array_except(col(b), col(a))) == 0)).cast("int")


def permuted(a, b) -> Column:
    """1 where one list is the other in another order."""
    return F.array_sort(col(a)).eqNullSafe(F.array_sort(col(b))).cast("int")


def inverse(p) -> Column:
    """Inverse of a permutation of 0 .. n-1: where each number stands."""
    return grade(p)


def is_sorted(a) -> Column:
    """1 where no item is below the one before."""
    return bound(a, lambda v: F.forall(index(F.size(v) - 1), lambda i: F.get(v, i) <= F.get(v, i + 1)).cast("int"))


def path(m, *at) -> Column:
    """Item at a path of positions and names, None standing for every item; null
    where it leads nowhere."""
    out = col(m)
    for n, i in enumerate(at):
        if i is None:
            return F.transform(out, lambda x: path(x, *at[n + 1 :]))
        out = out.getField(i) if isinstance(i, str) else F.get(out, i)
    return out


def spread(a, marks, width: int, fill) -> Column:
    """Items at the marked places of a list of ``width``, ``fill`` elsewhere."""
    place = lambda i: F.array_position(col(marks), i)
    return bound(a, lambda v: F.transform(index(F.lit(width)), lambda i: F.when(place(i) > 0, F.get(v, (place(i) - 1).cast("int"))).otherwise(fill)))


def reverse_infixes(a, lengths: list[int]) -> Column:
    """Parts of given lengths, each reversed in its place."""
    a, at, out = col(a), 0, []
    for n in lengths:
        out.append(F.reverse(F.slice(a, at + 1, n)))
        at += n
    return F.concat(*out)


def partition_sums(a, marks) -> Column:
    """Sum of each part of a list; a part starts at every mark."""
    a, marks = col(a), col(marks)
    starts = F.filter(F.transform(marks, lambda m, i: F.when(m != 0, i)), lambda i: i.isNotNull())

    def sums(s):
        return F.transform(s, lambda p, i: F.aggregate(F.slice(a, p + 1, F.coalesce(F.get(s, i + 1), F.size(a)) - p), F.lit(0.0), lambda x, y: x + y))

    return let(starts, sums)


def slide(f, a, step: int = 1) -> Column:
    """f of neighbours, every ``step`` places; a negative step swaps them."""
    s = abs(step)

    def pairs(v):
        n = F.floor((F.size(v) - 2) / s) + 1
        return F.transform(index(n), (lambda i: f(F.get(v, i * s + 1), F.get(v, i * s))) if step < 0 else (lambda i: f(F.get(v, i * s), F.get(v, i * s + 1))))

    return bound(a, pairs)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def mag(a) -> Column:
    return F.sqrt(dot(a, a))


def poly(coefficients, x) -> Column:
    """Value of a polynomial, highest power first."""
    return F.aggregate(col(coefficients), F.lit(0.0), lambda acc, c: acc * col(x) + c)
