"""Language identification by hierarchical discrimination.

A text is first given a language family, then a language of that family: linear
support vector machines decide both, one against the rest between families and
one against one within a family.  Features are hashed letter n-grams (1 to 4,
with word edges) of the words; a text's feature vector is the mean over its
words, so its margins are means of per-word margins, worked out once per distinct word
of a batch.  Training takes at most ``max_rows`` labelled rows, dealt
evenly over languages; the models are a table of fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm._common import extend, id_remainder, portions

#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi bn ur pa gu mr ne".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
GRAM, BITS = 4, 13
DIMS = 1 << BITS
#: Slope that turns margins into shares of one.
SLOPE = 4.0
_EDGES = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters; bytes beyond ASCII count as letters."""
    return text.lower().encode("utf-8", "replace").translate(_EDGES).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_hashes(words: list[bytes]):
    """Hashed n-grams of words between edge marks: a list of (hash, valid) over
    the bytes of all words end to end, one for each n, and each word's start."""
    s = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    edge = np.flatnonzero(s == 32)
    back = np.arange(1, len(s)) - np.repeat(edge[:-1], np.diff(edge))  # bytes since the word's opening mark
    s, h, out = s.astype(np.uint32), np.zeros(len(s), np.uint32), []
    for n in range(1, GRAM + 1):
        h = np.concatenate([[np.uint32(0)], h[:-1]]) * np.uint32(0x01000193) + s + np.uint32(n)
        out.append(((h[1:] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), back >= n - 1))
    return out, edge[:-1]


def text_vector(text: str) -> np.ndarray:
    """Mean n-gram counts over the words, as a dense vector."""
    words = words_of(text)
    if not words:
        return np.zeros(DIMS, np.float32)
    flat = np.concatenate([h[ok] for h, ok in gram_hashes(words)[0]])
    return (np.bincount(flat, minlength=DIMS) / len(words)).astype(np.float32)


def word_margins(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Margins (words x machines) before bias."""
    grams, starts = gram_hashes(words)
    return np.add.reduceat(sum(weights[h] * ok[:, None] for h, ok in grams), starts, axis=0)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; y is +1 or -1.
    The bias is a constant feature."""
    rng, n = np.random.default_rng(seed), len(y)
    w, b, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(n)
    norm = np.einsum("ij,ij->i", x, x).astype(float) + 1
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (float(x[i] @ w) + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w += np.float32(step) * x[i]
                b += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


class Model:
    """Families, their languages, and one weight column per machine."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.family = [FAMILY_OF.get(x.split("-")[0].lower(), x) for x in self.langs]
        self.families = sorted(set(self.family))
        self.pairs = [(i, j) for i in range(len(self.langs)) for j in range(i + 1, len(self.langs)) if self.family[i] == self.family[j]]
        self.weights = np.zeros((DIMS, len(self.families) + len(self.pairs)), np.float32)
        self.bias = np.zeros(self.weights.shape[1], np.float32)
        self.scale = 1.0

    def fit(self, x: np.ndarray, lang: np.ndarray) -> "Model":
        self.scale = 1.0 / max(float(np.sqrt((x**2).sum(axis=1)).mean()), 1e-9) if len(x) else 1.0
        x *= np.float32(self.scale)
        at = np.array([self.langs.index(v) for v in lang])
        fam = np.array([self.families.index(self.family[i]) for i in at])
        for k in range(len(self.families)):
            if len(self.families) > 1:
                self.weights[:, k], self.bias[k] = svm(x, np.where(fam == k, 1.0, -1.0))
        for k, (i, j) in enumerate(self.pairs, len(self.families)):
            of = (at == i) | (at == j)
            self.weights[:, k], self.bias[k] = svm(x[of], np.where(at[of] == i, 1.0, -1.0))
        self.weights *= np.float32(self.scale)
        return self

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins (texts x machines) to (language index, score): the family of
        the largest margin, then the language that wins most duels in it."""
        f = len(self.families)
        share = 1 / (1 + np.exp(-SLOPE * np.clip(margins, -50, 50)))
        family = margins[:, :f].argmax(axis=1)
        sure = share[:, :f][np.arange(len(margins)), family] if f > 1 else np.ones(len(margins))
        wins = np.zeros((len(margins), len(self.langs)))
        duels = np.zeros(len(self.langs))
        for k, (i, j) in enumerate(self.pairs, f):
            wins[:, i] += share[:, k]
            wins[:, j] += 1 - share[:, k]
            duels[i] += 1
            duels[j] += 1
        wins = np.where(duels > 0, wins / np.maximum(duels, 1), 1.0)
        of = np.array([self.families.index(x) for x in self.family])
        wins = np.where(of[None, :] == family[:, None], wins, -1.0)
        best = wins.argmax(axis=1)
        return best, sure * wins[np.arange(len(margins)), best]


def sample(rows: DataFrame, sizes: dict[str, int], each: int) -> DataFrame:
    """(lang, u, id, text): the first ``each`` distinct rows of every language by
    ``u``, a hash.  Only rows of a hash below a bound that about twice as many
    pass are ordered, so no language is one task's; where repeated rows leave too
    few, the bound grows."""
    spark, share = rows.sparkSession, {k: (2 * each + 64) / n for k, n in sizes.items()}
    while True:
        limits = spark.createDataFrame(list(share.items()), "lang string, _share double")  # a row per language
        near = rows.join(F.broadcast(limits), "lang").where(F.col("u") < F.col("_share") * 2.0**53)
        near = near.groupBy("lang", "u", "id").agg(F.min("text").alias("text"))
        found = {r["lang"]: r["count"] for r in near.groupBy("lang").count().collect()}
        short = [k for k, x in share.items() if found.get(k, 0) < each and x < 1]
        if not short:
            break
        share |= {k: 8 * share[k] for k in short}
    first = Window.partitionBy("lang").orderBy("u", "id", "text")
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= each).drop("r")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 2000, tie: str = "doc_id") -> Model | None:
    """Model of the non-null ``lang`` values of ``labelled``, from at most
    ``max_rows`` rows (the first of each language by a hash of ``tie`` and text,
    an even number each, 8 at least); None without labelled rows.  Rows alike in
    language, tie and text count once; null ties are ties like others; null texts
    teach nothing.  Reruns pick the same rows."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.shiftrightunsigned(F.xxhash64(tie, text), 11).alias("u"), F.col(tie).alias("id"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None

    def vectors(batches):
        import pyarrow as pa

        for batch in portions(batches, "text"):
            out = [text_vector(t) for t in batch.column("text").to_pylist()]
            at, v = [np.flatnonzero(v).astype(np.int32).tobytes() for v in out], [v[v > 0].tobytes() for v in out]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("u"), pa.array(at, pa.binary()), pa.array(v, pa.binary())], names=["lang", "u", "at", "v"])

    got = sample(rows, sizes, max(8, max_rows // len(sizes))).select("lang", "u", "text").mapInArrow(vectors, "lang string, u long, at binary, v binary").toPandas()
    got = got.sort_values(["lang", "u", "at", "v"], kind="stable").reset_index(drop=True)
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (at, v) in enumerate(zip(got["at"], got["v"])):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    return Model(list(sizes)).fit(x, got["lang"].to_numpy())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of the whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text without a model.  Letters in no learned script still get a learned
    language, with a low score.  All columns and repeated rows are kept.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: DIMS x machines
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    schema = docs.schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in portions(batches, "__text"):
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            rows, lids, counts, known = [], [], [], {}
            put = known.setdefault
            for i, t in enumerate(batch.column("__text").to_pylist()):
                if model is not None and has_letter(t):
                    words = words_of(t)
                    rows.append(i)
                    counts.append(len(words))
                    lids.append(np.array([put(w, len(known)) for w in words], np.int64))
            if rows:
                per_word = word_margins(list(known), model.weights)
                counts, where = np.array(counts), np.concatenate(lids)
                total = np.add.reduceat(per_word[where], np.cumsum(counts) - counts, axis=0)
                best, sure = model.decide(total / counts[:, None] + model.bias)
                names[rows], scores[rows] = np.array(model.langs, object)[best], sure
            yield extend(batch, "__text", {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return docs.withColumn("__text", F.col(text)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", mod: int = 3, rest: int = 1) -> Column:
    return id_remainder(id_col, mod) == rest


def identify(docs: DataFrame, max_rows: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from text and non-null lang of
    rows that are not held out."""
    model = train(docs.where(~held_out()), max_rows=max_rows)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
