"""Sessions with the settings the operators expect, errors by name, and the
session properties and system commands of the notation."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


class QuiverError(Exception):
    """Base of the error catalogue."""


def _error(name: str) -> type[QuiverError]:
    return type(f"{name.title()}Error_", (QuiverError,), {"code": name})


#: Names of errors, each with a class of its own.
ERRORS = {n: _error(n) for n in "rank length type value range domain valence index int parse stack reserved wsfull".split()}


def signal(code: str, message: str = "") -> None:
    raise ERRORS.get(code, QuiverError)(message or code)


def trap(fn, *args):
    """(0, result) or (1, error text), as protected application gives."""
    try:
        return 0, fn(*args)
    except Exception as e:  # noqa: BLE001  every failure is a value here
        return 1, getattr(e, "code", None) or str(e)


def session(app: str = "quiver", **conf) -> SparkSession:
    """Non-ANSI arithmetic (integers wrap), UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: The names of verbs and controls, which cannot be assigned.
RESERVED = set(
    "abs acos and asin at atan atan2 bd bh bin binl bz ceil choose ci cos cosh db decrypt del det di div dj do dot draw dv dvl encrypt ep erf erfc exit exp "
    "factor floor gamma gcd getenv gtime hb hypot ic if in inv jd kv lcm ldu lgamma lin log lsq lt ltime lu mag md5 modinv mul not nul or prime qr rename "
    "rint rot round rref setenv sha1 sha2 shift sin sinh sleep sm sqr sqrt ss ssr sv svd tan tanh timer tl trunc val vk vs watch while xor zb".split()
)


class Namespace:
    """Named values under a dotted prefix, with watchers that run after a name is
    assigned; a watcher that assigns its own name does not start itself again.
    Names may be qualified (``a.b``): namespaces below this one."""

    def __init__(self, spark: SparkSession, prefix: str = "k"):
        self.spark, self.prefix, self.values = spark, prefix, {}
        self.watchers: dict[str, list] = {}
        self._firing: set[str] = set()

    def assign(self, name: str, value) -> None:
        for part in name.split("."):
            if not part.replace("_", "a").isalnum() or part[:1].isdigit() or part in RESERVED:
                signal("reserved", name)
        self.values[name] = value
        if isinstance(value, DataFrame):
            value.createOrReplaceTempView(f"{self.prefix}_{name.replace('.', '_')}")
        if name not in self._firing:
            self._firing.add(name)
            try:
                for fn in self.watchers.get(name, []):
                    fn(value)
            finally:
                self._firing.discard(name)

    def amend(self, name: str, fn, *args) -> None:
        """``name f: args``: assign what ``fn`` makes of the present value."""
        self.assign(name, fn(self.get(name), *args))

    def amend_at(self, name: str, updates: DataFrame, value: str, pos: str = "pos") -> None:
        """``name[i]: v``: assign the vector with the updates' positions replaced."""
        from quiver.operators.tables import amend

        self.assign(name, amend(self.get(name), updates, value, pos))

    def get(self, name: str):
        if name not in self.values:
            signal("value", name)
        return self.values[name]

    def delete(self, name: str) -> None:
        self.get(name)
        del self.values[name]
        if self.spark is not None:
            self.spark.catalog.dropTempView(f"{self.prefix}_{name.replace('.', '_')}")

    def watch(self, name: str, fn) -> None:
        self.watchers.setdefault(name, []).append(fn)

    def names(self, below: str = "") -> list[str]:
        return sorted(n for n in self.values if n.startswith(below))

    def verbose(self) -> list[tuple[str, str]]:
        """(name, kind) of every value."""
        return [(n, "table" if isinstance(v, DataFrame) else type(v).__name__) for n, v in sorted(self.values.items())]


class Settings:
    """What the system commands set: digits printed, how close to zero is zero, and
    whether errors are raised or reported."""

    def __init__(self, digits: int = 7, zero: float = 0.0, raise_errors: bool = True):
        self.digits, self.zero, self.raise_errors = digits, zero, raise_errors

    def shown(self, column):
        """A number as it is printed under these settings."""
        from pyspark.sql import functions as F

        from quiver.functions.text import significant

        c = F.col(column) if isinstance(column, str) else column
        return significant(F.when(F.abs(c) < self.zero, 0.0).otherwise(c), self.digits)

    def run(self, fn, *args):
        return fn(*args) if self.raise_errors else trap(fn, *args)


def timed(action) -> tuple[float, object]:
    """(milliseconds, result) of an action."""
    t = time.perf_counter()
    out = action()
    return (time.perf_counter() - t) * 1000, out


class Console:
    """The system commands over a namespace, as lines that begin with a backslash."""

    HELP = {
        "l": "run a script", "t": "time an expression", "p": "digits printed", "zc": "how close to zero is zero", "e": "raise errors (1) or report them (0)", "d": "change the namespace",
        "m": "listen on a port", "v": "names", "V": "names and kinds", "\\\\": "end",
    }

    def __init__(self, ns: Namespace, settings: Settings | None = None, handlers: dict | None = None):
        self.ns, self.settings, self.handlers, self.at, self.listeners = ns, settings or Settings(), handlers or {}, "", []

    def run(self, line: str):
        from quiver.sources import remote, system

        word, _, rest = line[1:].partition(" ")
        if word == "" or word == "?":
            return self.HELP
        if word == "\\":
            system.leave(self.ns.spark)
        if word == "l":
            return system.load(rest)
        if word == "t":
            return timed(lambda: self.ns.spark.sql(rest).count())[0]
        if word == "p":
            self.settings.digits = int(rest or self.settings.digits)
            return self.settings.digits
        if word == "zc":
            self.settings.zero = float(rest or self.settings.zero)
            return self.settings.zero
        if word == "e":
            self.settings.raise_errors = bool(int(rest or self.settings.raise_errors))
            return int(self.settings.raise_errors)
        if word == "d":
            self.at = rest.strip()
            return self.at
        if word == "m":
            self.listeners.append(remote.Listener(self.handlers, int(rest or 0)))
            return self.listeners[-1].address[1]
        if word == "v":
            return self.ns.names(self.at)
        if word == "V":
            return [x for x in self.ns.verbose() if x[0].startswith(self.at)]
        signal("parse", line)
