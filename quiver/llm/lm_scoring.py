"""Language-model scoring by prediction by partial matching.

A byte-context trie, trained on the corpus, gives each byte of a text the
probability of the longest known context: ``(2c - 1) / 2T`` for a byte seen c times
among T there (d distinct), else the escape ``d / 2T`` times the probability
in the next shorter context, where the bytes already ruled out are excluded; past
the empty context, bytes are uniform.  Contexts reach ``ORDER`` bytes back, over the
blanks between tokens; before a text lie line feeds and a blank.  So a byte's code
length depends on one gram of ORDER + 1 bytes, and a text's on the sum over its grams.

Documents are read once and dealt into blocks of bounded text.  A block keeps its
texts and asks, once per distinct token and gram, for counts and code lengths.  What
it asks is filed under buckets: tokens by a hash, grams by a hash of the last
``NEAR`` bytes of their context, so that the contexts longer than that lie in
one bucket whole.  A bucket adds up what all blocks counted, and answers them.  The
counts of shorter contexts are a table of at most 2**24 entries whatever the
corpus, and are broadcast.  Sorted keys go as packed differences, one row for each block
and bucket; a gram or token that every text holds is one entry in one row of a
block, so no bucket is hot.  The trie grows with the corpus.

A gram is a long: its context from the nearest byte back, then the byte itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import id_remainder, materialize, portions

#: Longest context in bytes.
ORDER = 5
#: Bytes of a context that name its bucket; shorter contexts are broadcast.
NEAR = 3
#: Text bytes of a block, and places of its text worked on at once.
BLOCK, RUN = 8_000_000, 1 << 18
#: Symbols: 256 byte values and one to spare.
ALPHABET = 257
#: What lies before a text.
BEFORE = b"\n" * (ORDER - 1) + b" "


# ---- packed arrays ----------------------------------------------------------


@lru_cache(1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def planes(a: np.ndarray) -> bytes:
    """The bytes of eight-byte items, lowest bytes of all items first."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted unsigned keys, as differences, and their counts."""
    return _codec()[0].compress(planes(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)) + planes(counts.astype(np.int64)))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _codec()[1].decompress(blob)
    half = len(raw) // 2
    return np.cumsum(from_planes(raw[:half], np.uint64), dtype=np.uint64), from_planes(raw[half:], np.int64)


def pack_values(x: np.ndarray) -> bytes:
    """Doubles, of which many are equal: the distinct ones and places in them."""
    kinds, at = np.unique(x, return_inverse=True)
    return _codec()[0].compress(np.int64(len(kinds)).tobytes() + kinds.astype(np.float64).tobytes() + planes(at.astype(np.int64)))


def unpack_values(blob: bytes) -> np.ndarray:
    raw = _codec()[1].decompress(blob)
    end = 8 + 8 * int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw[8:end], np.float64)[from_planes(raw[end:], np.int64)]


# ---- blocks -----------------------------------------------------------------


def totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their ``n``."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers of 32-bit values."""
    mixed = (hashes.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Block:
    """Texts with their tokens numbered and their places laid end to end."""

    def __init__(self, texts: list[bytes], held: np.ndarray, buckets: int):
        known: dict[bytes, int] = {b"": 0}  # the end of a text
        put, lids, units = known.setdefault, [], []
        for t in texts:
            words = t.split()
            lids.append(np.array([put(w, len(known)) for w in words] + [0], np.int32))
            units.append(b" ".join([BEFORE[:-1], *words, b"\n"]))
        self.lids, self.words, self.buckets = lids, known, buckets
        self.held, self.sizes = np.asarray(held, bool), np.array([len(u) for u in units], np.int64)
        self.flat = np.frombuffer(b"".join(units), np.uint8)

    def runs(self):
        """(grams, number of the text of each) of the places, run by run."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        for a in range(ORDER, len(self.flat), RUN):
            b = min(len(self.flat), a + RUN)
            f, n = self.flat[a - ORDER : b].astype(np.uint64), b - a
            key = f[ORDER : ORDER + n].copy()
            for back in range(1, ORDER + 1):
                key |= f[ORDER - back : ORDER - back + n] << np.uint64(8 * (ORDER + 1 - back))
            at = np.arange(a, b)
            text = np.searchsorted(ends, at, side="right")
            inside = at - starts[text] >= ORDER  # what lies before a text is context only
            yield key[inside], text[inside]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams by (bucket, gram), and how often training texts hold them."""
        keys, sums = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for key, text in self.runs():
            marked = np.sort(key << np.uint64(1) | ~self.held[text])
            first = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
            n = np.diff(np.append(first, len(marked)))
            keys.append(marked[first] >> np.uint64(1))
            sums.append(np.where(marked[first] & np.uint64(1), n, 0))
            if sum(map(len, keys[1:])) > max(len(keys[0]), 1 << 20):
                keys, sums = ([x] for x in totals(np.concatenate(keys), np.concatenate(sums)))
        key, n = totals(np.concatenate(keys), np.concatenate(sums))
        order = np.argsort(self.gram_bucket(key), kind="stable")
        return key[order], n[order]

    def gram_bucket(self, key: np.ndarray) -> np.ndarray:
        return bucket_of(key >> np.uint64(8 * (ORDER + 1 - NEAR)), self.buckets)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the tokens by bucket and hash, how often training texts hold
        them, number of each)."""
        import xxhash

        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        train = [x for x, out in zip(self.lids, self.held) if not out]
        n = np.bincount(np.concatenate(train), minlength=len(h)) if train else np.zeros(len(h), np.int64)
        order = np.lexsort((h, self.token_bucket(h)))
        return h[order], n[order], order

    def token_bucket(self, h: np.ndarray) -> np.ndarray:
        return bucket_of(h >> np.uint64(32), self.buckets)


PARTS = "kind int, block long, bucket int, blob binary, ids array<long>, held array<boolean>, sizes array<int>"
HEAD, TOKENS, GRAMS, SHORT = range(4)


def filed(block: int, raw: list[bytes], ids: list, held: list, buckets: int):
    """The rows of a block."""
    import pyarrow as pa

    b, rows = Block(raw, held, buckets), []
    none = {"ids": None, "held": None, "sizes": None}
    rows.append({"kind": HEAD, "bucket": 0, "blob": _codec()[0].compress(b"".join(raw)), "ids": ids, "held": held, "sizes": [len(t) for t in raw]})

    def file(kind, key, n, bucket):
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
            rows.append({"kind": kind, "bucket": int(bucket[low]), "blob": pack(key[low:high], n[low:high])} | none)

    h, n, _ = b.tokens()
    file(TOKENS, h, n, b.token_bucket(h))
    g, n = b.grams()
    if len(g):
        file(GRAMS, g, n, b.gram_bucket(g))
    near = (g >> np.uint64(8 * (ORDER + 2 - NEAR))) << np.uint64(8) | (g & np.uint64(255))
    near, n = totals(near[n > 0], n[n > 0])
    rows.append({"kind": SHORT, "bucket": 0, "blob": pack(near, n)} | none)
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))])
    yield pa.RecordBatch.from_pylist([r | {"block": block} for r in rows], schema)


def blocks_of(docs: DataFrame, id_col: str, text: str, mod: int, rest: int, buckets: int) -> DataFrame:
    """A row HEAD per block with its texts, rows TOKENS and GRAMS per block and
    bucket with what it asks and counts, and a row SHORT with its counts in
    contexts shorter than ``NEAR``."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), (id_remainder(id_col, mod) == rest).alias("held"), F.col(text).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        at, raw, ids, held, size = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in portions(batches, "text"):
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("id", "held", "text"))):
                raw.append((t or "").encode("utf-8", "replace").lower())
                ids.append(i)
                held.append(h)
                size += len(raw[-1]) + 64
                if size >= BLOCK:
                    yield from filed(at, raw, ids, held, buckets)
                    at, raw, ids, held, size = at + 1, [], [], [], 0
        if ids:
            yield from filed(at, raw, ids, held, buckets)

    return narrow.mapInArrow(run, PARTS)


# ---- the trie ---------------------------------------------------------------


class Level:
    """Counts ``c`` of (context, byte) keys, sorted, and of each context: total
    ``t``, distinct bytes ``d``, and what of the next shorter context is left
    (``xt``, ``xd``) once the bytes seen here are excluded."""

    def __init__(self, key: np.ndarray, c: np.ndarray, shorter: "Level | None", parent):
        self.key, self.c = key, c
        ctx = key >> np.uint64(8)
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(key) else np.zeros(0, np.int64)
        self.node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        self.t, self.d = (np.add.reduceat(x, first) if len(key) else np.zeros(0, np.int64) for x in (c, (c > 0).astype(np.int64)))
        self.xt = self.xd = np.zeros(len(first), np.int64)
        if shorter is not None and len(key):
            up = shorter.at(parent(key))
            above = shorter.found(up, key.shape)
            ruled = np.add.reduceat(np.where(c > 0, above, 0), first)
            node = up[first]
            some = node < len(shorter.key)
            node = shorter.node[np.minimum(node, len(shorter.key) - 1)] if len(shorter.key) else np.zeros(len(first), np.int64)
            self.xt = np.where(some, shorter.t[node] - ruled, 0) if len(shorter.key) else self.xt
            self.xd = np.where(some, shorter.d[node] - self.d, 0) if len(shorter.key) else self.xd

    def at(self, key: np.ndarray) -> np.ndarray:
        """Place of each (context, byte), or of another byte of its context, or
        the number of keys where the context is unknown."""
        if not len(self.key):
            return np.zeros(len(key), np.int64)
        i = np.searchsorted(self.key, key)
        inside = np.minimum(i, len(self.key) - 1)
        same = self.key[inside] >> np.uint64(8) == key >> np.uint64(8)
        before = np.maximum(i - 1, 0)
        back = self.key[before] >> np.uint64(8) == key >> np.uint64(8)
        return np.where(same, inside, np.where(back, before, len(self.key)))

    def found(self, at: np.ndarray, shape) -> np.ndarray:
        """Counts at places; 0 where there is none."""
        if not len(self.key):
            return np.zeros(shape, np.int64)
        return np.where(at < len(self.key), self.c[np.minimum(at, len(self.key) - 1)], 0)

    def asked(self, key: np.ndarray):
        """(c, t, d, xt, xd) of (context, byte) keys; t is 0 for an unknown context."""
        at = self.at(key)
        if not len(self.key):
            return (np.zeros(len(key), np.int64),) * 5
        known, inside = at < len(self.key), np.minimum(at, len(self.key) - 1)
        node = self.node[inside]
        c = np.where(known & (self.key[inside] == key), self.c[inside], 0)
        return (c, *(np.where(known, x[node], 0) for x in (self.t, self.d, self.xt, self.xd)))


def shorter_key(key: np.ndarray) -> np.ndarray:
    """(context, byte) without the context's farthest byte."""
    return (key >> np.uint64(16)) << np.uint64(8) | (key & np.uint64(255))


def short_levels(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of the contexts of 0 .. NEAR - 1 bytes, from the counts of the longest."""
    tables = [(key, n)]
    for _ in range(NEAR - 1):
        tables.append(totals(shorter_key(tables[-1][0]), tables[-1][1]))
    out: list[Level] = []
    for k, c in reversed(tables):
        out.append(Level(k, c, out[-1] if out else None, shorter_key))
    return out


_HELD: dict = {}


def levels_of(counts: tuple[np.ndarray, np.ndarray]) -> list[Level]:
    """Short levels, worked out once in a worker."""
    if _HELD.get("of") is not counts:
        _HELD.update(of=counts, levels=short_levels(*counts))
    return _HELD["levels"]


def code_lengths(gram: np.ndarray, n: np.ndarray, short: list[Level]) -> np.ndarray:
    """log10 probability of each gram's last byte, for the distinct sorted grams
    of whole NEAR-byte contexts with their training counts."""
    tables = [(gram, n)]
    for _ in range(ORDER - NEAR):
        tables.append(totals(shorter_key(tables[-1][0]), tables[-1][1]))
    levels = list(short)
    for k, c in reversed(tables):
        levels.append(Level(k, c, levels[-1], shorter_key))
    logp, left, key = np.zeros(len(gram)), np.arange(len(gram)), gram
    ruled = np.zeros(len(gram), bool)
    rest_t, rest_d, out = (np.zeros(len(gram), np.int64) for _ in range(3))
    for k in range(ORDER, -1, -1):
        c, t, d, xt, xd = levels[k].asked(key)
        t_, d_ = np.where(ruled, rest_t, t), np.where(ruled, rest_d, d)
        known = t > 0
        hit, miss = known & (c > 0), known & (c == 0)
        logp[left[hit]] += np.log10((2 * c[hit] - 1) / (2 * t_[hit]))
        escape = miss & (d_ > 0)
        logp[left[escape]] += np.log10(d_[escape] / (2 * t_[escape]))
        out, rest_t, rest_d, ruled = np.where(miss, d, out), np.where(miss, xt, rest_t), np.where(miss, xd, rest_d), ruled | miss
        go = ~hit
        left, key, ruled, rest_t, rest_d, out = left[go], shorter_key(key[go]), ruled[go], rest_t[go], rest_d[go], out[go]
        if not len(left):
            return logp
    logp[left] -= np.log10(ALPHABET - out)
    return logp


# ---- operator ---------------------------------------------------------------


def short_counts(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts in contexts of NEAR - 1 bytes: at most 2**24 entries."""

    def run(batches):
        import pyarrow as pa

        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                k, n = unpack(blob)
                keys, sums = totals(np.concatenate([keys, k]), np.concatenate([sums, n]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(sums)], names=["key", "n"])

    each = parts.where(F.col("kind") == SHORT).select("blob").mapInArrow(run, "key int, n long")
    got = each.groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return got["key"].to_numpy(np.uint64), got["n"].to_numpy(np.int64)


ANSWER = "kind int, block long, bucket int, blob binary, total long, kinds long"


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mod: int = 10, rest: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Trains on documents whose id's crc32 modulo ``mod`` is not ``rest``; a null
    id counts as empty text there and stays null in the result.  A token is a run
    of non-blanks, A-Z lowered, and one end per text; null text is an empty one.
    ``score`` is the log10 probability of those tokens in their order, blanks
    between them being one symbol.  Repeated rows are scored, and counted in
    training, each on its own.  Texts of any length are worked on in runs; a long
    one is a block of its own.  An empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    buckets = min(1 << 16, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = materialize(blocks_of(docs, id_col, text, mod, rest, buckets))

    def add_up(pdf):
        asked = [unpack(b) for b in pdf["blob"]]
        key, n = totals(np.concatenate([k for k, _ in asked]), np.concatenate([n for _, n in asked]))
        return key, n, [np.searchsorted(key, k) for k, _ in asked]

    def told(pdf, values, n, at):
        out = pd.DataFrame({"kind": pdf["kind"], "block": pdf["block"], "bucket": pdf["bucket"], "blob": [pack_values(values[i]) for i in at], "total": 0, "kinds": 0})
        out.loc[out.index[:1], ["total", "kinds"]] = [int(n.sum()), int((n > 0).sum())]
        return out

    def count(pdf):
        _, n, at = add_up(pdf)
        return told(pdf, n.astype(np.float64), n, at)

    asked = parts.select("kind", "block", "bucket", "blob")
    counted = materialize(asked.where(F.col("kind") == TOKENS).groupBy("bucket").applyInPandas(count, ANSWER))
    total, kinds = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(short_counts(parts))  # at most 2**24 entries

    def cost(pdf):
        key, n, at = add_up(pdf)
        return told(pdf, code_lengths(key, n, levels_of(shared.value)), n, at)

    paid = asked.where(F.col("kind") == GRAMS).groupBy("bucket").applyInPandas(cost, ANSWER)
    answers = counted.union(paid).select("kind", "block", "bucket", "blob")
    heads = parts.where(F.col("kind") == HEAD).select(F.col("block").alias("home"), "ids", "held", "sizes", "blob")

    def finish(key, head, told):
        told = told.sort_values(["kind", "bucket"])
        h = head.iloc[0]
        c, logp = (np.concatenate([np.zeros(0), *map(unpack_values, told["blob"][told["kind"] == k])]) for k in (TOKENS, GRAMS))
        ends, raw = np.cumsum(np.asarray(h["sizes"], np.int64)).tolist(), _codec()[1].decompress(h["blob"])
        b = Block([raw[e - n : e] for e, n in zip(ends, h["sizes"])], h["held"], buckets)
        costs, (distinct, _) = np.zeros(len(ends)), b.grams()
        order = np.argsort(distinct)
        distinct, logp = distinct[order], logp[order]
        for grams, text in b.runs():
            own, which = np.unique(grams, return_inverse=True)
            sums = np.bincount(text - text[:1], logp[np.searchsorted(distinct, own)][which])
            costs[int(text[0]) : int(text[0]) + len(sums)] += sums
        counts = np.zeros(len(c))
        counts[b.tokens()[2]] = c
        sizes, lids = np.array([len(x) for x in b.lids]), np.concatenate(b.lids)
        first = np.cumsum(sizes) - sizes
        base = np.log10((counts + 0.1) / (total + 0.1 * (kinds + 1)))
        return pd.DataFrame({
            "doc_id": pd.array(list(h["ids"]), dtype="Int64"), "held_out": np.asarray(h["held"], bool), "n_tokens": sizes,
            "n_known": np.add.reduceat((counts > 0).astype(np.int64)[lids], first), "train_tokens": total,
            "base_score": np.add.reduceat(base[lids], first), "score": costs,
        })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heads.groupBy("home").cogroup(answers.groupBy("block")).applyInPandas(finish, out)
