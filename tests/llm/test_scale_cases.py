"""Cases that grow: many matches in a text, broken markup, sources of millions of
blocks, repeated ids; and operators held against their method said plainly."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import html_extraction, language_id, mixing, secret_scan, simhash_dedup, toxicity


def took(f, *args):
    t = time.perf_counter()
    f(*args)
    return time.perf_counter() - t


# ---- 1 and 5: samples and decisions ------------------------------------------------


def test_language_decides_by_its_machines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    f = len(model.families)
    for r in language_id.predict(docs, model).limit(60).collect():
        if not language_id.has_letter(r.text):
            assert r.lang_pred == "und" and r.score == 0
            continue
        margins = language_id.text_vector(r.text).astype(float) @ model.weights + model.bias
        family = model.families[int(margins[:f].argmax())]
        share = 1 / (1 + np.exp(-language_id.SLOPE * margins))
        inside = [i for i, x in enumerate(model.family) if x == family]
        wins = {i: [share[k] if a == i else 1 - share[k] for k, (a, b) in enumerate(model.pairs, f) if i in (a, b)] for i in inside}
        mean = {i: np.mean(w) if w else 1.0 for i, w in wins.items()}
        best = max(inside, key=lambda i: mean[i])
        assert r.lang_pred == model.langs[best]
        assert r.score == pytest.approx((share[model.families.index(family)] if f > 1 else 1.0) * mean[best], abs=1e-4)


def test_language_sample_is_the_same_in_any_order(spark):
    texts = ["the cat and the dog were here", "der hund und die katze waren da", "un chat et un chien", "el perro y el gato"]
    rows = [(i % 50, f"{texts[i % 4]} {i % 400}", "en de fr es".split()[i % 4]) for i in range(1600)] + [(None, "the cow", "en"), (7, "the cat", "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_id.train(docs.repartition(n), max_rows=64) for n in (2, 7))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)
    sizes = {"en": 1000, "de": 400, "fr": 400, "es": 400}
    narrow = docs.select("lang", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("u"), F.col("doc_id").alias("id"), "text")
    got = {r["lang"]: r["count"] for r in language_id.sample(narrow, sizes, 16).groupBy("lang").count().collect()}
    assert got == dict.fromkeys(sizes, 16)
    one = narrow.where("id is null")
    assert language_id.sample(one, {"en": 300}, 16).count() == 1  # rows alike count once


def test_toxicity_recall_and_repeated_ids(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    rate = {r.toxic: r.p for r in got}
    assert rate[1] >= 0.75 and rate[0] <= 0.02
    rows = [(i % 10, f"word{i} nice text {i % 7}") for i in range(400)]
    few, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    a, b = (toxicity.train(few.repartition(n), marks) for n in (2, 7))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_toxicity_by_plain_ftrl(spark):
    """Weights and scores against per-coordinate updates in dictionaries."""
    texts = ["you are bad bad", "what a nice day", "bad day for you", "nice nice people here", "you people are bad", "a day of rest", ""]
    marks = [1, 0, 1, 0, 1, 0, 0]

    def coordinates(text):
        words = [zlib.crc32(w) for w in toxicity.words_of(text)]
        mul = lambda a, b: a * b & 0xFFFFFFFF
        out = {mul(h, 0x9E3779B1) >> 12 for h in words}
        for gap, salt in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
            for a, b in zip(words, words[gap:]):
                x = mul(a, salt) ^ mul((b + gap) & 0xFFFFFFFF, 0x27D4EB2F)
                out.add(mul(x ^ (x >> 15), 0x9E3779B1) >> 12)
        return sorted(out)

    rows = [(np.array(coordinates(t), np.int32), y) for t, y in zip(texts, marks)] * 12
    z, n, bz, bn = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= 6 else -np.sign(z[i]) * (abs(z[i]) - 6) / (1 + np.sqrt(n[i]) + 1)
    rng = np.random.default_rng(7)
    for _ in range(5):
        for k in rng.permutation(len(rows)):
            at, y = rows[k]
            b = -bz / (1 + np.sqrt(bn))
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
            for i, x in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) * x
                n[i] = old + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) * b
            bn += g * g
    model = toxicity.fit(rows)
    want = {i: weight(i) for i in z if weight(i)}
    assert model[0].tolist() == sorted(want) and np.allclose(model[1], [want[i] for i in sorted(want)], rtol=1e-4)
    bias = -bz / (1 + np.sqrt(bn))
    plain = [1 / (1 + np.exp(-(sum(want.get(i, 0.0) for i in coordinates(t)) + bias))) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.predict(df, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(plain, rel=1e-4) and got[0] > 0.5 > got[1]


# ---- 2 ---------------------------------------------------------------------------


def plain_spans(text):
    out = []
    for kind, rx in (("assign", secret_scan.ASSIGN), ("access", secret_scan.ACCESS), ("hex", secret_scan.HEX)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rx, text) if kind != "assign" or len(m[1]) >= 6]
    return out


def test_secrets_many_matches_in_a_text(spark):
    unit = "é token=abcdef {} x password: 12 " + "0a" * 12 + " "
    text = "".join(unit.format(i) for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, text[:3000])], "doc_id long, text string").repartition(2)
    for r in secret_scan.report(df).collect():
        want = plain_spans(text if r.doc_id == 1 else text[:3000])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in ("assign", "access", "hex"))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want))
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    want, last = [], 0
    for a, _, b in sorted(plain_spans(text)):
        want += [text[last:a], "[REDACTED]"]
        last = b
    assert clean[1] == "".join(want) + text[last:]
    long = spark.createDataFrame([(1, "token=abcdef " * 80_000)], "doc_id long, text string")
    assert took(lambda: secret_scan.report(long).collect()) < 30 and took(lambda: secret_scan.redact(long).collect()) < 60


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 63, 64, 65, 1000])
def test_running(spark, n):
    x = [(i * 7919) % 101 for i in range(n)]
    df = spark.createDataFrame([(x,)], "x array<int>")
    got = df.select(secret_scan.running(F.col("x"), lambda a, b: a + b), secret_scan.running(F.col("x"), lambda a, b: F.greatest(a, b))).first()
    assert got[0] == np.cumsum(x).tolist() and got[1] == np.maximum.accumulate(np.array(x, int)).tolist()


# ---- 7 ---------------------------------------------------------------------------

P = [f"Paragraph {i} of the main text is long enough to say a thing or two about the matter at hand." for i in range(5)]
NAV = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "About", "Contact")) + "</ul>"
PARAS = "".join(f"<p>{x}</p>" for x in P)
BARE = {
    "plain": (f"<body>{NAV}<div>{PARAS}</div></body>", P),
    "heading": (f"<body>{NAV}<div><h1>Head</h1>{PARAS}</div></body>", ["Head", *P]),
    "close": (f"<body><div>{PARAS}<p><a href=#>A link</a></p><p>The end.</p></div>{NAV}</body>", [*P, "A link", "The end."]),
    "list": (f"<body><div>{PARAS}<ul><li>One thing</li><li>Another</li></ul></div></body>", [*P, "One thing", "Another"]),
    "table": (f"<table><tr><td>{NAV}</td><td>{PARAS}</td></tr></table>", P),
    "comments": (f"<div>{PARAS}</div><div class=comments><p>{P[0]}</p></div>", P),
    "footer": (f"<div>{PARAS}</div><div id=footer><p>{P[1]} All rights reserved.</p></div>", P),
    "advert": (f"<div>{P[0]}<div class='ad'>Buy this thing now, it is the best of all the things there are.</div>{P[1]}</div>", P[:2]),
    "unclosed": (f"<div><p>{P[0]}<p>{P[1]}<br>{P[2]}", P[:3]),
    "quoted": (f"<nav>{NAV}</nav><div><blockquote>{P[3]}</blockquote><p>{P[4]}</p></div>", P[3:5]),
}


@pytest.mark.parametrize("name", sorted(BARE))
def test_pages_with_no_article(name):
    page, want = BARE[name]
    assert html_extraction.main_text(page).split("\n") == want


def test_pages_do_not_need_article_elements(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert html_extraction.main_text(r.html) == html_extraction.main_text(re.sub(r"<(/?)article", r"<\1div", r.html))


BROKEN = {
    "open tags": lambda n: "<a " * n + '"', "quotes": lambda n: '<a "' * n, "end tags": lambda n: "<b>" * n + "</i>" * n, "rules": lambda n: "<p>" + "<b>" * n + "<hr>" * n,
    "scripts": lambda n: "<script></script " * n, "articles": lambda n: "<article>x" * n, "comments": lambda n: "<!--" * n, "sections": lambda n: "<![CDATA[" * n,
    "blocks": lambda n: "<div><p>word " * n, "drawings": lambda n: "<svg/>" * n, "inline": lambda n: "<b>" * n + "<div>x" * n,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    assert took(html_extraction.main_text, BROKEN[name](100_000)) < 8


# ---- 8 ---------------------------------------------------------------------------


def test_permutation_back():
    for n in (1, 2, 5, 1000, 4097):
        x, of, key = np.arange(n), np.full(n, n), np.full(n, 1234567)
        assert np.array_equal(mixing.permute(mixing.permute(x, of, key), of, key, back=True), x)
    big = np.array([0, 5, 10**11 - 1])
    there = mixing.permute(big, np.full(3, 10**11), np.full(3, 9))
    assert np.array_equal(mixing.permute(there, np.full(3, 10**11), np.full(3, 9), back=True), big)


@pytest.mark.parametrize("slots", [[1000, 1, 0, 77], [5], [4096, 4096], [0, 0], []])
def test_shards_add_up_in_any_parts(slots):
    got = list(mixing.shard_counts(slots, 64, 3))
    total = sum(slots)
    assert [s for s, *_ in got] == list(range(-(-total // 64)))
    assert all(c.sum() == min(64, total - 64 * s) and c.min() >= 0 for s, c, _ in got)
    if got:
        counts = np.array([c for _, c, _ in got])
        assert counts.sum(axis=0).tolist() == slots and np.array_equal(np.cumsum(counts, axis=0) - counts, [b for *_, b in got])
    parts = [x for a in range(0, len(got), 3) for x in mixing.shard_counts(slots, 64, 3, a, a + 3)]
    assert [(s, c.tolist(), b.tolist()) for s, c, b in parts] == [(s, c.tolist(), b.tolist()) for s, c, b in got]


def test_shards_of_a_source_of_billions_of_blocks():
    slots = [3 * 10**9, 10**6, 5]
    t = time.perf_counter()
    got = list(mixing.shard_counts(slots, 4096, 1, 700_000, 700_050))
    assert time.perf_counter() - t < 5 and len(got) == 50 and all(c.sum() == 4096 and c[0] > 3900 for _, c, _ in got)
    assert took(mixing.draw_slots, 10**14, 1.7 * 10**14, 1024, 2, 42) < 1


@pytest.mark.parametrize("size,target,block", [(1000, 1000, 64), (1000, 2500, 64), (1001, 77, 64), (63, 63, 64), (4097, 9000.4, 1024), (4097, 4098, 4096)])
def test_slots_make_the_target(size, target, block):
    n = -(-size // block)
    count, last = mixing.draw_slots(size, target, block, 3, 42)
    words = 0
    for j in range(count):
        b = int(mixing.permute(np.array([j % n]), np.array([n]), mixing.key_of(3, np.array([j // n]), 42))[0])
        whole = size - (n - 1) * block if b == n - 1 else block
        words += min(whole, last) if j == count - 1 else whole
    assert words == round(target)


def test_mix_sizes_against_sql(spark, sf_dir):
    import duckdb

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in mixing.mix_report(docs).collect()}
    sql = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) size FROM '{sf_dir}/documents.parquet'),
      s AS (SELECT source, sum(size) n, row_number() OVER (ORDER BY source NULLS LAST) - 1 i FROM d GROUP BY 1) SELECT doc_id, size, n, i FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
    rows = duckdb.sql(sql).fetchall()
    sizes = dict(sorted({(i, int(n)) for *_, n, i in rows}))
    goal = mixing.targets(list(sizes.values()), [1 + i % 3 for i in sizes])
    assert got == {(d, n, int(s), round(goal[i], 6)) for d, n, s, i in rows}


# ---- 9 ---------------------------------------------------------------------------


def test_fingerprints_are_majorities(spark, sf_dir):
    import xxhash

    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect():
        words = (r.text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash_dedup.text_fingerprint(r.text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_session_settings_stay(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    simhash_dedup.simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)).count()
    assert spark.conf.get(key) == was
