import pytest

from quiver.functions import udf
from quiver.plans.notation import fold, select
from quiver.plans.session import ERRORS
from quiver.sources import system


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("a", 1, 2.0), ("b", 2, 0.0), ("a", 3, 5.0)], "k string, x int, y double")


def test_right_to_left(df):
    out = select(df, a="2*x+1", b="(2*x)+1", c="x%y", d="-x", e="x>1", f='k="a"', g="5!x").collect()
    assert [r.a for r in out] == [4, 6, 8] and [r.b for r in out] == [3, 5, 7]
    assert out[1].c == float("inf") and [r.d for r in out] == [-1, -2, -3] and [r.e for r in out] == [0, 1, 1]
    assert [r.f for r in out] == [1, 0, 1] and [r.g for r in out] == [0, 1, 2]


def test_folds(df):
    got = {r.k: (r.s, r.m) for r in fold(df, ["k"], where="y>0", s="+/x*y", m="|/x").collect()}
    assert got == {"a": (17.0, 3)}
    assert fold(df, where="x>9", s="+/x", p="*/x").first()[:] == (0, 1.0)


@pytest.mark.parametrize("text", ["", "x+", "x x", "(x", "x;y", "__import__('os')", "<x"])
def test_refused(df, text):
    with pytest.raises((ERRORS["parse"], ERRORS["valence"], ERRORS["rank"], ERRORS["value"])):
        select(df, a=text)


@pytest.mark.parametrize("text,want", [
    ("2*v", [6, 2, 4]), ("v+v", [6, 2, 4]), ("+/v", 6), ("+\\v", [3, 4, 6]), ("|/v", 3), ("*v", 3), ("|v", [2, 1, 3]), ("#v", 3), ("<v", [1, 2, 0]), ("v@<v", [1, 2, 3]),
    ("v[2]", 2), ("v[0 2]", [3, 2]), ("2#v", [3, 1]), ("-1_v", [3, 1]), ("v,v", [3, 1, 2, 3, 1, 2]), ("v?2", 2), ("?v,v", [3, 1, 2]), ("&v>1", [0, 2]), ("v[&v>1]", [3, 2]),
    ("{x*x}'v", [9, 1, 4]), ("v{x-y}'v", [0, 0, 0]), ("{x+2*y}/v", 9), ("{[a;b]c:a*b;c+1}[2;3]", 7), (":[x>1;10;20]", 20), ("x:[0;1;2]", None), ("2 3#v", [[3, 1, 2], [3, 1, 2]]),
    ("(2 3#v)[1;0]", 3), ("(2 3#v)[;0]", [3, 3]), ("+2 3#v", [[3, 3], [1, 1], [2, 2]]), ("1 +/v", [4, 2, 3]), ("v -\\1", [2, 0, 1]), ("!4", [0, 1, 2, 3]), ("v~|v", 0), ("v~v", 1),
    ("{_ x%2}/9", 0), ("{_ x%2}\\9", [9, 4, 2, 1, 0]), ("0 2_v", [[3, 1], [2]]), ("+/'2 3#v", [6, 6]), ("5-3", 2), ("5 -3", [5, -3]), ("x-1", 0), ("=v,3", [[0, 3], [1], [2]]), ("$v", ["3", "1", "2"]), ("+/{x*x}'!5", 30),
])
def test_lists(spark, text, want):
    one = spark.createDataFrame([(1, [3, 1, 2])], "x int, v array<int>")
    if want is None:
        with pytest.raises(tuple(ERRORS.values())):
            select(one, a=text)
    else:
        assert select(one, a=text).first().a == want


def test_functions_as_values(df):
    f = udf.project(lambda a, b, c: (a, b, c), 1, udf.OPEN, 3)
    assert f(2) == (1, 2, 3) and udf.valence(lambda a, b: 0) == 2 and udf.compose(abs, min)([-3, 2]) == 3
    assert [r.v for r in df.select(udf.column(lambda v: v * 10, "int")("x").alias("v")).collect()] == [10, 20, 30]
    got = udf.fold_groups(df, ["k"], "x", "x", lambda a, b: a * 10 + b, 0, "long").collect()
    assert {tuple(r) for r in got} == {("a", 13), ("b", 2)}
    assert udf.expand(df, lambda r: [(r["x"], i) for i in range(r["x"])], "x int, i int").count() == 6


def test_system(spark, tmp_path):
    system.setenv("QUIVER_T", "1")
    assert system.getenv("QUIVER_T") == "1" and system.getenv("QUIVER_NONE") == ""
    with pytest.raises(ERRORS["domain"]):
        system.run(spark, ["echo", "x"])
    spark.conf.set(system.ALLOW, "true")
    assert system.run(spark, ["echo", "x"]) == (0, ["x"], [])
    spark.conf.set(system.ALLOW, "false")
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "load.py").write_text("a = 5")
    assert system.load(str(tmp_path / "pkg"))["a"] == 5
