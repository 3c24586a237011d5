"""Edge cases of every operator: nulls, empty and long texts, ties, repeated
rows, empty tables, clashing column names; and small brute-force comparisons."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import html_extraction, language_id, lm_scoring, metric_join, mixing, nearest, packing, secret_scan, simhash_dedup, toxicity
from quiver.llm._common import connected_components
from quiver.llm.queries import oracle_sql, queries, tokenizer_path
from tests.oracle import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid string, size int, score string, start int, base string, v int"
LONG = " ".join(f"word{i % 97}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, None, "en", "a"), (3, "", "de", None), (4, " \n\t ", None, "b"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"), (5, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (None, "Der schnelle braune Fuchs springt", "de", None), (7, LONG, "en", "a"), (8, "12345 !!!", None, ""), (9, "The quick brown fox jumps over the lazy dog", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, None, "x", 1, "y", 2, "z", 3) for i, t, lang, s in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    check(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 99), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


# ---- 1 language -------------------------------------------------------------


def test_language(spark, docs, empty, sf_dir):
    out = language_id.identify(docs).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1
    assert Counter(r.lang_pred for r in out)["und"] == 4
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(table).join(table, "doc_id").where("held_out").select((F.col("lang_pred") == F.col("lang")).alias("ok")).collect()
    assert sum(r.ok for r in got) / len(got) > 0.95


# ---- 2 secrets ----------------------------------------------------------------


def test_secret_edges(spark, docs, empty):
    access, mixed = "AKIA" + "A" * 16, "aB3" + "xY9z" * 10
    rows = [
        (1, f"token=token: abcdefghij {access}"), (2, f"{access} {mixed} https://a.example/x"), (3, f"{mixed} https://a.example/x"),
        (4, f"{access} " + "w " * 400 + mixed), (5, "é PASSWORD : 'secret1'"), (6, "a" * 24 + "AKIA" + "B" * 15), (7, None), (7, None), (None, f"{access}"),
    ]
    got = {r.doc_id: r for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_assign == 0 and got[1].spans == "access:24:44"
    assert got[2].spans == f"access:0:20,secret:21:{21 + len(mixed)},endpoint:{22 + len(mixed)}:{41 + len(mixed)}"
    assert got[3].spans == "" and got[4].spans == "access:0:20" and got[5].spans == "assign:2:21"
    assert got[6].spans == "hex:0:24" and got[7].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert secret_scan.report(docs).count() == len(TEXTS) and secret_scan.report(empty).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[5] == "é [REDACTED]'" and clean[7] is None and clean[3] == rows[2][1]


# ---- 3 and 10 vectors ------------------------------------------------------------


VECS = "vec_id long, embedding array<float>, label int, cls string, v int"


def vec_rows(seed=0, n=300, d=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, d))
    x = [(base[i % 20] + rng.normal(size=d) * rng.choice([0.05, 0.3])).astype(np.float32).tolist() for i in range(n)]
    rows = [(i, v, 0, "c", 1) for i, v in enumerate(x)]
    odd = [None, [0.0] * d, [1.0, None] * (d // 2), [float("nan")] * d, [float("inf")] * d, [1.0, 2.0], x[0], x[0]]
    return rows + [(1000 + i, v, 1, "c", 1) for i, v in enumerate(odd)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_metric_join(spark, monkeypatch):
    rows = vec_rows()
    good = {i: np.array(v, float) for i, v, *_ in rows if fine(v)}
    near = defaultdict(set)
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                near[i].add(j)
    comp = {i: i for i, *_ in rows}
    for _ in range(40):
        for i in comp:
            comp[i] = min([comp[i], *(comp[j] for j in near[i])])
    want = {(i, len(near[i]), comp[i], comp[i] == i) for i in comp}
    df = spark.createDataFrame(rows, VECS)
    assert {tuple(r) for r in metric_join.similarity_join(df, pivots=7).collect()} == want
    monkeypatch.setattr(metric_join, "HOME", 16)
    monkeypatch.setattr(metric_join, "GUEST", 32)
    assert {tuple(r) for r in metric_join.similarity_join(df, pivots=3).collect()} == want
    assert metric_join.similarity_join(df.limit(0)).count() == 0


def test_metric_join_near_equal_pivots(spark):
    """Vectors all within the threshold of each other, two of them 1e-9 apart."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(size=8), rng.normal(size=8)
    p /= np.sqrt(p @ p)
    u -= (u @ p) * p
    u /= np.sqrt(u @ u)
    rows = [(i, (p + s * u).tolist()) for i, s in enumerate([0, 1e-9, 0.05, -0.05, 0.1, -0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for seed in range(31, 36):
        assert [(r.n_links, r.component_id) for r in metric_join.similarity_join(df, pivots=2, seed=seed).collect()] == [(5, 0)] * 6
    x = np.stack([np.array(v) for _, v in rows])
    home = np.arange(6) % 2
    border = metric_join.border_distance(x, x[:2], home)
    assert np.isfinite(border).all() and (np.abs(border) < 0.2).all()


def test_metric_join_magnitudes(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [5e-324, 5e-324]), (4, [1.7e308, 1.7e308]), (5, [1e200, -1e200])]
    got = metric_join.similarity_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.n_links for r in got.collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 0}


def brute_nearest(rows, is_query, k=10):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and fine(v)]
    want = Counter()
    for a, (q, x) in enumerate(good):
        if is_query(q):
            d = sorted((float(nearest.distance(x[None], y[None])[0]), i) for b, (i, y) in enumerate(good) if a != b and len(x) == len(y))
            want.update((q, r + 1, i, s) for r, (s, i) in enumerate(d[:k]))
    return want


def test_nearest(spark, monkeypatch):
    rows = vec_rows(1)
    df = spark.createDataFrame(rows, VECS)
    plain = {(q, r, i): s for q, r, i, s in brute_nearest(rows, lambda i: i % 100 == 0 and i < 1000)}
    good = {i: np.array(v, float) for i, v, *_ in rows if fine(v)}
    assert all(s == math.sqrt(np.add.accumulate((good[q] - good[i]) ** 2)[-1]) for (q, _, i), s in plain.items())
    monkeypatch.setattr(nearest, "CANDIDATES", 64)
    monkeypatch.setattr(nearest, "QUERIES", 2)
    monkeypatch.setattr(nearest, "HEADS", 1)
    got = nearest.nearest(df, "vec_id % 100 = 0 and vec_id < 1000").collect()
    assert Counter(map(tuple, got)) == brute_nearest(rows, lambda i: i % 100 == 0 and i < 1000)
    few = nearest.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]
    assert nearest.nearest(df.limit(0), "true").count() == 0


def test_nearest_repeated_ids_and_magnitudes(spark):
    rng = np.random.default_rng(4)
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.5]), (100, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (None, [1.0, 2.0])]
    rows += [(200, [1e200, 1e200]), (201, [1e200, 2e200]), (300, [1e-310, 2e-310]), (301, [5e-324, 0.0]), (302, [1e-310, 3e-310]), (303, [-1.7e308, 1.7e308])]
    rows += [(400 + i, (rng.normal(size=2) * 10.0 ** rng.integers(-300, 300)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, nearest.nearest(df, "vec_id % 100 = 0").collect()))
    assert got == brute_nearest(rows, lambda i: i % 100 == 0) and sum(got.values()) == 60


@pytest.mark.parametrize("pairs", [50, 1 << 20])
def test_nearest_of_dense_neighbourhoods(spark, monkeypatch, pairs):
    """Copies of one vector by the hundred, and a crowd closer than a code can tell."""
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    monkeypatch.setattr(nearest, "ROWS", 128)
    rng = np.random.default_rng(6)
    p = rng.normal(size=6)
    rows = [(i, p.tolist()) for i in range(300)] + [(i, (p + 1e-7 * rng.normal(size=6)).tolist()) for i in range(300, 700)] + [(i, rng.normal(size=6).tolist()) for i in range(700, 800)]
    got = Counter(map(tuple, nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 100 = 0").collect()))
    assert got == brute_nearest(rows, lambda i: i % 100 == 0)


def test_metric_join_of_one_crowd(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PAIRS", 500)
    rng = np.random.default_rng(7)
    rows = [(i, (np.ones(4) + 0.01 * rng.normal(size=4)).tolist()) for i in range(400)]
    got = metric_join.similarity_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(399, 0, True), (399, 0, False)}


# ---- 4 packing -----------------------------------------------------------------


def test_plan_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(120):
        w = int(rng.choice([8, 16, 64]))
        hist = {int(k): int(rng.integers(1, 9)) for k in rng.integers(1, w + 1, rng.integers(1, 8))}
        plan, seqs = packing.make_plan(hist, w), defaultdict(list)
        for length, n in hist.items():
            got = defaultdict(list)
            for which, start, size, seq, off in packing.place(plan, length, np.arange(n)):
                for a, b, s, q, o in zip(*np.broadcast_arrays(which, start, size, seq, off)):
                    got[int(a)].append((int(b), int(s)))
                    seqs[int(q)].append((int(o), int(s)))
            for k in range(n):
                assert sum(s for _, s in got[k]) == length and sorted(got[k])[0][0] == 0
        for x in seqs.values():
            x.sort()
            assert x[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(x, x[1:])) and sum(s for _, s in x) <= w
        assert len(seqs) == plan.sequences == -(-sum(k * n for k, n in hist.items()) // w)


def test_fill_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(100):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 5)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        got = packing.fill(counts, 50)
        assert sum(k * m for k, m in got.items()) == max(s for s in sums if s <= 50) and all(m <= counts[k] for k, m in got.items())


def test_encoder():
    enc = packing.Encoder(tokenizer_path())
    for t in ["", "a", " a  b", "a\n\nb", "tab\tx", "it's we'll I'M", "日本語 é", "x <|endoftext|> y", "a\x1cb", "é\xa0b ½²", "don’t — “q”", " \n a", "a \nb", TEXTS[4][1], LONG]:
        assert enc.encode(t) == packing.pack_ids(enc.tok.encode(t, add_special_tokens=False).ids), t[:40]


def test_pack(spark, docs, empty):
    out = packing.pack(docs, tokenizer_path(), ids=True).toPandas()
    enc, want = packing.Encoder(tokenizer_path()), Counter()
    for i, t, *_ in TEXTS:
        want[(i, enc.encode(t or "") + packing.pack_ids([0]))] += 1
    got = Counter()
    for _, g in out.groupby("row_id"):
        g = g.sort_values("start")
        blob = b"".join(bytes(x) for x in g.ids)
        i = g.doc_id.iloc[0]
        got[(None if i != i else int(i), blob)] += 1
        assert [zlib.crc32(bytes(x)) for x in g.ids] == g.ids_crc32.tolist() and (g.doc_tokens * 4 == len(blob)).all()
    assert got == want
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(empty, tokenizer_path()).count() == 0


# ---- 5 toxicity -------------------------------------------------------------------


def test_toxicity(spark, docs, empty, sf_dir):
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (None, 1, 1), (7, 1, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in out)
    assert toxicity.score(empty, labels).count() == 0
    assert not any(r.predicted for r in toxicity.score(docs, labels.limit(0)).collect())
    table, marks = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.score(table, marks).join(marks, "doc_id").where("toxic = 0").agg(F.avg("predicted").alias("p")).first().p
    assert got < 0.05


# ---- 6 language model ---------------------------------------------------------------


def lm_stream(t):
    return b"\n\n\n\n " + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"


def lm_trie(texts):
    trie = defaultdict(Counter)
    for s in map(lm_stream, texts):
        for at in range(5, len(s)):
            for k in range(lm_scoring.ORDER + 1):
                trie[s[at - k : at]][s[at]] += 1
    return trie


def lm_cost(trie, s):
    total = 0.0
    for at in range(5, len(s)):
        out = set()
        for k in range(lm_scoring.ORDER, -1, -1):
            left = {x: n for x, n in trie.get(s[at - k : at], {}).items() if x not in out}
            if s[at] in left:
                total += math.log10((2 * left[s[at]] - 1) / (2 * sum(left.values())))
                break
            if left:
                total += math.log10(len(left) / (2 * sum(left.values())))
                out |= set(left)
        else:
            total -= math.log10(257 - len(out))
    return total


@pytest.mark.parametrize("block", [300, 100_000])
def test_lm_against_brute_force(spark, docs, empty, sf_dir, monkeypatch, block):
    """Whole texts, blanks included, in many blocks and runs, and base scores."""
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    monkeypatch.setattr(lm_scoring, "RUN", 77 if block == 300 else 4096)
    words = "the cat sat on the mat and the dog lay by the door of the old house".split()
    rows = [(i, " ".join(words[i % 5 :] + words[: i % 3])) for i in range(40)] + [(41, None), (42, " a  b\n")]
    rows += [(100 + i, " ".join(words[::s])) for i in range(30) for s in (1, -1)]
    if block > 300:
        few = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("doc_id", "text")
        rows = [tuple(r) for r in few.union(docs.where("doc_id <> 7 or doc_id is null").select("doc_id", "text")).collect()]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    split = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c = Counter(t for i, w in split if crc(i) % 10 for t in w)
    n, v, trie = sum(c.values()), len(c), lm_trie([t for i, t in rows if crc(i) % 10])
    want = sorted(
        (i or -1, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 5), round(lm_cost(trie, lm_stream(t)), 5))
        for (i, w), (_, t) in zip(split, rows)
    )
    got = lm_scoring.score(table).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert all(r.held_out == (crc(r.doc_id) % 10 == 0) for r in got) and lm_scoring.score(empty).count() == 0


def test_lm_long_text_is_a_block(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 1000)
    rows = [(1, "ab " * 20_000), (2, "ab ab"), (3, None)]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    trie = lm_trie([t for i, t in rows if crc(i) % 10])
    assert {i: round(lm_cost(trie, lm_stream(t)), 4) for i, t in rows} == {i: round(r.score, 4) for i, r in got.items()}


def test_lm_order_counts_and_blanks_help(spark, sf_dir):
    """Shuffled words score otherwise, and lower in sum; the held-out sum is better than that of a model
    whose contexts stop at each word, on the same trie method."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").limit(120).select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    mixed = [(i + 10**6 if crc(i) % 10 == 0 else None, " ".join(sorted((t or "").split(), key=lambda w: zlib.crc32(w.encode())))) for i, t in rows]
    mixed = [(next(j for j in range(i, i + 10**4) if crc(j) % 10 == 0), t, i - 10**6) for i, t in mixed if i is not None]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows + [m[:2] for m in mixed], "doc_id long, text string")).collect()}
    long = [(got[j], got[i]) for j, t, i in mixed if len(t.split()) > 5]
    assert long and all(a != b for a, b in long) and sum(a for a, _ in long) < sum(b for _, b in long)


def test_lm_against_word_bounded_contexts(spark):
    """The held-out sum is better than that of the same method with contexts that
    stop at each word's start."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600).select("doc_id", "text").collect()]
    trie, known = defaultdict(Counter), {}
    for w, n in Counter(w for i, t in rows if crc(i) % 10 for w in (t or "").encode().lower().split()).items():
        s = b" " + w + b" "
        for at in range(1, len(s)):
            for k in range(min(at, 5) + 1):
                trie[s[at - k : at]][s[at]] += n

    def bounded(w):
        s, total = b" " + w + b" ", 0.0
        for at in range(1, len(s)):
            out = set()
            for k in range(min(at, 5), -1, -1):
                left = {x: n for x, n in trie.get(s[at - k : at], {}).items() if x not in out}
                if s[at] in left:
                    total += math.log10((2 * left[s[at]] - 1) / (2 * sum(left.values())))
                    break
                if left:
                    total += math.log10(len(left) / (2 * sum(left.values())))
                    out |= set(left)
            else:
                total -= math.log10(257 - len(out))
        return total

    held = Counter(w for i, t in rows if crc(i) % 10 == 0 for w in (t or "").encode().lower().split())
    known = sum(n * bounded(w) for w, n in held.items())
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.96 * known


# ---- 7 pages ------------------------------------------------------------------------


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two\n three<p>Was.</article><footer>foot</footer>"
    rows = [(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (None, "u", "<p>plain", 4), (5, "u", "<p>x" * 20000, 5), (5, "u", "<script>var a = '<p>no</p>'", 6)]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    got = sorted((r.page_id or -1, r.text) for r in out)
    assert got == sorted([(1, "Head\nOne & two three\nWas."), (2, ""), (3, ""), (-1, "plain"), (5, "\n".join(["x"] * 20000)), (5, "")])
    assert all(r.n_chars == len(r.text) for r in out)


def test_pages_without_article():
    page = (
        "<div class='top-menu'><a href=#>One</a></div><div id=sidebar>Long text in the side bar that should not be kept at all</div>"
        "<div><p>A long paragraph of text that is certainly the content of this page, with many words.</p><div>Short.</div>"
        "<p>Another long paragraph of text that belongs to it as well, with quite some words.</p></div>"
        "<div class=comments>Somebody wrote a long comment about this page here</div><form>Search</form><div class='cookie-notice'>We use cookies</div>"
    )
    assert html_extraction.main_text(page).split("\n")[1:] == ["Short.", "Another long paragraph of text that belongs to it as well, with quite some words."]


def test_pages_against_template(spark, sf_dir):
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"<(?:p|/p|br|h1|/h1)>", body)
        want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|\Z)", "", y))).strip() for y in parts) if x)
        assert html_extraction.main_text(r.html) == want


def test_pages_article_beside_main_text():
    long = [f"Paragraph {i} of the main text is long enough to say a thing or two about it." for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in long)
    card = "<article><a href=#>Card</a></article>"
    assert html_extraction.main_text(f"<div>{body}</div>{card}").split("\n") == long
    assert html_extraction.main_text(f"<main><h1>Head</h1>{body}{card}</main><p>Imprint").split("\n") == ["Head", *long]
    assert html_extraction.main_text("<p>Menu<article><p>Short.</article>") == "Short."


def test_pages_keep_every_stretch():
    text = [f"Paragraph {i} of the main text is long enough to say a thing or two about it." for i in range(6)]
    links = [f"See also {i}" for i in range(4)]
    some, rest = ("".join(f"<p>{x}</p>" for x in half) for half in (text[:4], text[4:]))
    ul = "<ul>" + "".join(f"<li><a href=#>{x}</a></li>" for x in links) + "</ul>"
    whole = [*text[:4], *links, *text[4:]]
    assert html_extraction.main_text(f"<div>{some}{ul}{rest}</div>").split("\n") == whole
    assert html_extraction.main_text(f"<div>{some}</div><div>{ul}</div><div>{rest}</div>").split("\n") == text
    one = "<p><a href=#>A sentence that is a link</a></p>"
    assert html_extraction.main_text(f"<div>{some}{one}{rest}</div>").split("\n") == [*text[:4], "A sentence that is a link", *text[4:]]


def test_pages_names_inside_article():
    own = [
        '<section id="discussion"><p>Discussed.</section>', '<h2 id="related-work">Related work</h2>', '<h2 id="skip-lists">Skip lists</h2>', '<p class="alert">Take care.</p>',
        '<div id="social-policy">Policy.</div>', "<figure><img src=x><figcaption>A figure.</figcaption></figure>", '<div class="related"><p>' + "Long text of the article. " * 8 + "</div>",
    ]
    boxes = '<div class="share">Tell others</div><ul class="social"><li>Follow us</ul><div id="comments"><p>First!</div>'
    want = ["Discussed.", "Related work", "Skip lists", "Take care.", "Policy.", "A figure.", ("Long text of the article. " * 8).strip()]
    assert html_extraction.main_text(f"<article>{''.join(own)}{boxes}</article>").split("\n") == want


# ---- 8 mixing ------------------------------------------------------------------------


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99)).tolist()) == list(range(n))


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 200, 10], [1, 2, 3]) == pytest.approx([30, 160, 30])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


@pytest.mark.parametrize("block", [4, 64, 1024])
def test_mix(spark, docs, empty, block):
    a, b = (sorted((r.doc_id or -1, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_report(docs.repartition(k), block=block).collect()) for k in (1, 5))
    assert a == b
    out = mixing.mix_report(docs, block=block).join(docs.select("doc_id", "source").distinct(), "doc_id", "left")
    per = mixing.mix_report(docs.withColumn("doc_id", F.monotonically_increasing_id()), block=block)
    for r in per.collect():
        assert r.taken <= 3 * r.size
    by = docs.withColumn("doc_id", F.monotonically_increasing_id())
    sums = mixing.mix_report(by, block=block).join(by.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("size").alias("n"), F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(r.n == r.s and abs(r.t - r.k) <= 0.5 + 1e-9 for r in sums) and out.count() >= len(TEXTS)
    assert mixing.mix_report(empty, block=block).count() == 0
    texts = {r.text for r in mixing.mix_texts(docs, block=block).collect()}
    assert all(any(t in (x or "") for _, x, *_ in TEXTS) for t in texts)


# ---- 9 fingerprints ---------------------------------------------------------------------


def test_fingerprints_edges(spark, docs, empty):
    import xxhash

    assert simhash_dedup.text_fingerprint(None) == simhash_dedup.text_fingerprint(" \n") == 0
    assert simhash_dedup.text_fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    got = {(r.doc_id, r.component_id, r.kept) for r in simhash_dedup.simhash_groups(docs).collect()}
    assert {(2, 2, True), (3, 2, False), (4, 2, False), (1, 1, True), (9, 1, False), (5, 5, True), (5, 5, False)} <= got
    assert simhash_dedup.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("bucket,pairs", [(4, 1 << 20), (4096, 1 << 20), (4096, 10)])
def test_search_against_brute_force(spark, monkeypatch, bucket, pairs):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    monkeypatch.setattr(simhash_dedup, "PAIRS", pairs)
    rng = np.random.default_rng(bucket)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]]))
    label = np.arange(len(fps))
    for _ in range(30):
        for i in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[i]) <= 4
            label[near] = label[near].min()
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "_fp long")
    roots = {r.node: r.root for r in connected_components(simhash_dedup.link_edges(df)).collect()}
    mine = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    pairs = set(zip(mine, label.tolist()))
    assert len(pairs) == len(set(mine)) == len(set(label.tolist()))


@pytest.mark.parametrize("n", [10, 10**5, 10**8])
def test_thresholds_cover_the_radius(n):
    sample = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    chosen = simhash_dedup.plan(sample, n, 4)
    used = [b for _, bits, _ in chosen for b in bits]
    assert len(used) == len(set(used)) and sum(t + 1 for _, _, t in chosen) == 5
