"""A text front-end: expressions of the array notation over the columns of a table,
compiled to Column expressions.

Right to left without precedence, as the notation reads: ``2*a+1`` is 2*(a+1).
Array columns are lists: atomic verbs reach into them, ``2*v`` doubles every item.
There are verbs of one and two arguments, the adverbs each ``'``, fold and each-right
``/``, scan and each-left ``\\``, indexing ``v[i]``, lambdas ``{x+y}`` and ``{[a;b]t:a*b;t+1}``,
the conditional ``:[c;a;b]`` and calls ``f[a;b]``.  Only this grammar is accepted, and
names are columns or what a lambda binds, so no text can run code.

In :func:`select` a fold works inside a list; in :func:`fold` a fold of a column of atoms
goes over the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions import expr as e
from quiver.functions import text as t
from quiver.operators import cells as c
from quiver.plans.session import signal

_TOKEN = re.compile(
    r"\s*(?:(?P<num>-?\d+\.?\d*(?:e-?\d+)?)|(?P<str>\"[^\"]*\")|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<cond>:\[)|(?P<verb>[-+*%&|<>=!~_^#?,@$])|(?P<adverb>['/\\])|(?P<mark>[()\[\]{};:]))"
)


@dataclass
class Val:
    """A column and how many lists deep it is; ``const`` is a literal's value."""

    col: Column
    depth: int = 0
    const: object = None


@dataclass
class Fn:
    """A function of ``valence`` arguments."""

    call: Callable
    valence: int


def each(f: Callable, *args: Val) -> Val:
    """f of atoms, reached into lists; lists of one depth go item by item."""
    top = max(a.depth for a in args)
    if top == 0:
        return Val(f(*[a.col for a in args]))
    if len(args) == 1:
        return Val(F.transform(args[0].col, lambda x: each(f, Val(x, top - 1)).col), top)
    a, b = args
    if a.depth == b.depth:
        return Val(c.each2(lambda x, y: each(f, Val(x, top - 1), Val(y, top - 1)).col, a.col, b.col), top)
    if a.depth > b.depth:
        return Val(F.transform(a.col, lambda x: each(f, Val(x, top - 1), b).col), top)
    return Val(F.transform(b.col, lambda y: each(f, a, Val(y, top - 1)).col), top)


ATOMIC2 = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": e.divide, "&": lambda a, b: F.least(a, b), "|": lambda a, b: F.greatest(a, b),
    "<": lambda a, b: (a < b).cast("int"), ">": lambda a, b: (a > b).cast("int"), "=": lambda a, b: (a == b).cast("int"), "!": e.modulo, "^": e.power,
}
ATOMIC1 = {"-": lambda a: -a, "%": e.reciprocal, "~": e.not_, "_": e.floor}
ROWS = {"+": lambda a: F.coalesce(F.sum(a), F.lit(0)), "*": lambda a: F.coalesce(F.product(a), F.lit(1.0)), "&": F.min, "|": F.max}


def _list(v: Val) -> Val:
    return v if v.depth else signal("rank", "a list is wanted")


#: Verbs of one list: how each changes the depth, and what it does.
LISTS1 = {
    "*": (-1, c.first), "|": (0, c.reverse), "&": (0, c.where), "<": (0, c.grade), ">": (0, lambda a: c.grade(a, up=False)), "=": (1, c.group), "#": (None, c.count),
    "?": (0, c.distinct), "^": (None, c.shape), "+": (0, c.flip),
}


def monad(verb: str, v: Val) -> Val:
    if verb in ATOMIC1:
        return each(ATOMIC1[verb], v)
    if verb == ",":
        return Val(c.enlist(v.col), v.depth + 1)
    if verb == "!":
        return Val(c.index(v.col), 1) if not v.depth else signal("rank", "!")
    if verb == "$":
        return each(lambda a: F.coalesce(a.cast("string"), F.lit("")), v)
    if verb == "@":
        return Val(F.lit(int(not v.depth)))
    if verb == "+" and v.depth < 2:
        return v
    if verb not in LISTS1:
        signal("valence", verb)
    change, f = LISTS1[verb]
    if not v.depth:
        return v if verb in "*|" else signal("rank", verb)
    return Val(f(v.col), v.depth + change if change is not None else int(verb == "^"))


def dyad(verb: str, a: Val, b: Val) -> Val:
    if verb in ATOMIC2:
        return each(ATOMIC2[verb], a, b)
    if verb == "~":
        return Val(c.match(a.col, b.col) if a.depth == b.depth else F.lit(0))
    if verb == ",":
        deep = max(a.depth, b.depth, 1)
        wrap = lambda v: v.col if v.depth == deep else F.array(v.col)
        return Val(F.concat(wrap(a), wrap(b)), deep)
    if verb == "?":
        return Val(c.find(_list(a).col, b.col)) if b.depth < a.depth else Val(F.transform(b.col, lambda x: c.find(a.col, x)), 1)
    if verb == "@":
        return index(a, [b])
    if verb in "#_":
        n = a.const
        if isinstance(n, int):
            return Val((c.take if verb == "#" else c.drop)(n, b.col), b.depth) if b.depth else Val(F.array_repeat(b.col, n), 1)
        if isinstance(n, list) and verb == "_":
            return Val(c.cut(n, _list(b).col), b.depth + 1)
        if isinstance(n, list) and len(n) == 2:
            return Val(c.reshape(_list(b).col, *n), 2)
        signal("type", f"{verb} wants whole numbers on its left")
    return signal("valence", verb)


def index(v: Val, at: list[Val | None]) -> Val:
    """Items at positions, a list of positions giving a list; None stands for all."""
    i, rest = at[0], at[1:]
    _list(v)
    inner = lambda x: index(x, rest) if rest else x
    if i is None:
        return Val(F.transform(v.col, lambda x: inner(Val(x, v.depth - 1)).col), v.depth - sum(x is not None and not x.depth for x in rest))
    if not i.depth:
        return inner(Val(F.get(v.col, i.col.cast("int")), v.depth - 1))
    got = inner(Val(F.get(v.col, F.lit(0)), v.depth - 1)).depth
    return Val(F.transform(i.col, lambda k: inner(Val(F.get(v.col, k.cast("int")), v.depth - 1)).col), got + i.depth)


def of_verb(verb: str) -> Fn:
    return Fn(lambda *a: monad(verb, *a) if len(a) == 1 else dyad(verb, *a), 2)


def item(v: Val) -> Val:
    return Val(F.get(v.col, 0), v.depth - 1)


def derived(f: Fn, adverb: str, rows: bool, verb: str | None) -> Fn:
    """What an adverb makes of a function."""

    def call(*args):
        if adverb == "'":
            return zipped(f, args)
        if len(args) == 2:  # each-right and each-left
            a, b = args
            over = _list(b if adverb == "/" else a)
            pair = (lambda x: f.call(a, x)) if adverb == "/" else (lambda x: f.call(x, b))
            return Val(F.transform(over.col, lambda x: pair(Val(x, over.depth - 1)).col), pair(item(over)).depth + 1)
        (v,) = args
        if f.valence == 1:  # to the fixed point
            step = lambda x: f.call(Val(x, v.depth)).col
            v = Val(F.when(F.lit(False), step(v.col)).otherwise(v.col), v.depth)  # of the type that f gives
            return Val(c.converge(step, v.col), v.depth) if adverb == "/" else Val(c.converge_scan(step, v.col), v.depth + 1)
        if not v.depth:
            if rows and adverb == "/" and verb in ROWS:
                return Val(ROWS[verb](v.col))
            return v if not rows else signal("rank", f"{verb or 'a lambda'}{adverb}")
        step = lambda x, y: f.call(Val(x, v.depth - 1), Val(y, v.depth - 1)).col
        return Val(c.over(step, v.col), v.depth - 1) if adverb == "/" else Val(c.scan(step, v.col), v.depth)

    return Fn(call, 1 if adverb != "'" else f.valence)


def zipped(f: Fn, args) -> Val:
    lists = [a for a in args if a.depth]
    if not lists:
        return f.call(*args)
    out = f.call(*[item(a) if a.depth else a for a in args]).depth + 1
    if len(lists) == 1:
        return Val(F.transform(lists[0].col, lambda x: f.call(*[Val(x, a.depth - 1) if a.depth else a for a in args]).col), out)

    def at(*xs):
        left = iter(xs)
        return f.call(*[Val(next(left), a.depth - 1) if a.depth else a for a in args]).col

    return Val(c.each_n(at, *[a.col for a in lists]), out)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            signal("parse", text[at:])
        kind, s = m.lastgroup, m[m.lastgroup]
        after = out[-1] if out else ("", "")
        noun = after[0] in ("name", "str") or after[1] in (")", "]", "}") or (after[0] == "num" and not m[0][0].isspace())
        if kind == "num" and s[0] == "-" and noun:
            out.append(("verb", "-"))  # behind a noun a sign is the verb; 5 -3 is a list
            kind, s = "num", s[1:]
        out.append((kind, s))
        at = m.end()
    return out


class Parser:
    def __init__(self, todo: list, names: dict, rows: bool):
        self.todo, self.names, self.rows = todo, names, rows

    def peek(self) -> tuple[str, str]:
        return self.todo[0] if self.todo else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        if not self.todo or (mark is not None and self.todo[0][1] != mark):
            signal("parse", mark or "nothing")
        return self.todo.pop(0)

    def adverbs(self, f: Fn, verb: str | None) -> Fn:
        while self.peek()[0] == "adverb":
            f, verb = derived(f, self.take()[1], self.rows, verb), None
        return f

    def ends(self) -> bool:
        return self.peek()[0] == "end" or self.peek()[1] in (")", "]", "}", ";")

    def expression(self):
        kind, s = self.peek()
        if self.ends():
            signal("parse", s or "nothing")
        if kind == "verb":
            self.take()
            f = self.adverbs(of_verb(s), s)
            return f.call(self.expression())
        left = self.noun()
        if isinstance(left, Fn):
            f = self.adverbs(left, None)
            if self.peek()[1] != "[":
                return f if self.ends() else f.call(self.expression())
            self.take()
            left = f.call(*self.listed("]"))
        if self.ends():
            return left
        if self.peek()[0] == "verb":
            s = self.take()[1]
            return self.adverbs(of_verb(s), s).call(left, self.expression())
        if self.peek()[1] == "{":
            f = self.adverbs(self.noun(), None)
            return f.call(left, self.expression())
        return signal("parse", self.peek()[1])

    def listed(self, close: str) -> list:
        """Expressions between semicolons, None for one left out."""
        out = []
        while True:
            out.append(None if self.peek()[1] in (";", close) else self.expression())
            if self.take()[1] == close:
                return out

    def noun(self):
        kind, s = self.take()
        if kind == "num":
            found = [s]
            while self.peek()[0] == "num":
                found.append(self.take()[1])
            whole = all(re.fullmatch(r"-?\d+", x) for x in found)
            xs = [int(x) if whole else float(x) for x in found]
            out = Val(F.lit(xs[0]), 0, xs[0]) if len(xs) == 1 else Val(F.array(*map(F.lit, xs)), 1, xs)
        elif kind == "str":
            out = Val(F.lit(s[1:-1]))
        elif kind == "name":
            if s not in self.names:
                signal("value", s)
            out = self.names[s]
        elif kind == "cond":
            return self.conditional(self.listed("]"))
        elif s == "(":
            parts = self.listed(")")
            if len(parts) == 1 and parts[0] is not None:
                out = parts[0]
            elif None in parts or len({p.depth for p in parts}) != 1:
                signal("parse", "a list of unlike items")
            else:
                out = Val(F.array(*[p.col for p in parts]), parts[0].depth + 1)
        elif s == "{":
            out = self.function()
        else:
            signal("parse", s)
        while self.peek()[1] == "[":
            self.take()
            given = self.listed("]")
            out = out.call(*given) if isinstance(out, Fn) else index(out, given)
        return out

    @staticmethod
    def conditional(parts: list) -> Val:
        if len(parts) < 3 or len(parts) % 2 == 0 or None in parts:
            signal("valence", ":[")
        *pairs, last = parts
        out = None
        for test, value in zip(pairs[::2], pairs[1::2]):
            out = F.when(test.col != 0, value.col) if out is None else out.when(test.col != 0, value.col)
        return Val(out.otherwise(last.col), last.depth)

    def function(self) -> Fn:
        """A lambda: its body is read again for each call, over its arguments."""
        named = None
        if self.peek()[1] == "[":
            self.take()
            named = []
            while self.peek()[1] != "]":
                named.append(self.take()[1])
                if self.peek()[1] == ";":
                    self.take()
            self.take("]")
        body, open_ = [], 1
        while True:
            tok = self.take()
            open_ += {"{": 1, "}": -1}.get(tok[1], 0)
            if not open_:
                break
            body.append(tok)
        if named is None:
            used = {s for k, s in body if k == "name"}
            named = ["x", "y", "z"][: max([1, *(n + 1 for n, x in enumerate("xyz") if x in used)])]
        outer, rows = dict(self.names), self.rows

        def call(*args):
            if len(args) != len(named):
                signal("valence", f"{len(args)} for {len(named)}")
            inside, out = Parser(list(body), outer | dict(zip(named, args)), rows), None
            while inside.todo:
                name = inside.todo[0][1] if len(inside.todo) > 1 and inside.todo[0][0] == "name" and inside.todo[1][1] == ":" else None
                if name:
                    inside.todo = inside.todo[2:]
                out = inside.expression()
                if name:
                    inside.names[name] = out
                if inside.todo:
                    inside.take(";")
            return out if out is not None else signal("parse", "an empty lambda")

        return Fn(call, len(named))


def parse(text: str, df: DataFrame, rows: bool = False) -> Column:
    """Column of an expression over the columns of ``df``."""
    names = {n: Val(F.col(f"`{n}`"), kind.count("array<")) for n, kind in df.dtypes}
    p = Parser(tokens(text), names, rows)
    out = p.expression()
    if p.todo:
        signal("parse", p.todo[0][1])
    return out.col if isinstance(out, Val) else signal("type", "a function is no column")


def select(df: DataFrame, **columns: str) -> DataFrame:
    """Expressions as columns, row by row."""
    return df.select(*[parse(x, df).alias(n) for n, x in columns.items()])


def fold(df: DataFrame, by: list[str] | None = None, where: str | None = None, **columns: str) -> DataFrame:
    """Folds, per group if ``by`` is given, of the rows where an expression is not 0."""
    rows = df.where(parse(where, df) != 0) if where else df
    return rows.groupBy(*(by or [])).agg(*[parse(x, df, rows=True).alias(n) for n, x in columns.items()])


def show(df: DataFrame, digits: int = 7, **columns: str) -> DataFrame:
    """Numeric expressions as printed."""
    return df.select(*[t.significant(parse(x, df), digits).alias(n) for n, x in columns.items()])
