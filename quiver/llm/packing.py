"""Packing token sequences into fixed windows by minimum bin slack.

Tokenising streams over the documents once.  A document's ids (an end id added)
are cut into whole windows and one tail; all that is planned is the histogram of
tail lengths, which has fewer entries than a window has tokens.

Planning (driver, on the histogram): each step takes the longest length left and
finds, by a subset-sum dynamic program over bitsets, the multiset of remaining
lengths that fills its window closest to capacity; counts are backtracked and
the pattern is repeated as often as counts allow.  A longest length that no
multiset completes without slack is set aside; what was set aside is laid end to
end at last and cut at window ends, so only the last window of all is padded.

Assignment: a tail is known by its rank among tails of its length: its rank in
the task that read it plus the count of earlier tasks, both small tables.  The
plan maps ranges of ranks to sequence and offset, in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm._common import extend, materialize, portions

END_ID = 0


# ---- tokens ----------------------------------------------------------------


class Encoder:
    """Text to little-endian four-byte ids, as the tokenizer file gives them.

    Where the file is byte-level BPE, a text of Latin script without runs of
    blanks is split by a pattern that needs no look-ahead and merged by the same
    ranks, which takes a seventh of the time; any other text goes to the tokenizer.
    """

    #: The pre-token pattern of byte-level BPE where no run of blanks is longer than one.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tok, self.merge = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.odd = re.compile("[^\n\x20-\x7e\xa1-ɏ]").search
        pairs = (x.split(" ") if isinstance(x, str) else x for x in spec["model"].get("merges", []))
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and all(vocab["".join(m)] == 256 + i for i, m in enumerate(pairs)):
            import tiktoken

            byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.added}
            self.merge = tiktoken.Encoding("units", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.merge is None or self.odd(text) or any(a in text for a in self.added) or any(a in text for a in ("  ", "\n\n", " \n", "\n ")):
            return pack_ids(self.tok.encode(text, add_special_tokens=False).ids)
        return pack_ids(self.merge(text))


def pack_ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others for letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# ---- plan ------------------------------------------------------------------


@dataclass
class Range:
    """Tails [lo, ..) of one length: ``per`` of them lie in each repetition of a
    pattern, from ``offset`` of sequence ``first`` on; or, with ``stream``, end
    to end from token ``offset`` after the start of sequence ``first``."""

    lo: int
    first: int
    per: int
    offset: int
    stream: bool = False


@dataclass
class Plan:
    window: int
    ranges: dict[int, list[Range]] = field(default_factory=dict)
    sequences: int = 0


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of lengths (at most ``counts`` of each) with the largest sum not
    above ``capacity``: bitsets of reachable sums after each binary share of a
    length, walked back from the best sum."""
    full = (1 << (capacity + 1)) - 1
    reach, trail = 1, []
    for length in sorted(counts, reverse=True):
        left, share = min(counts[length], capacity // length), 1
        while left > 0:
            share = min(share, left)
            trail.append((length, share, reach))
            reach |= (reach << (length * share)) & full
            left -= share
            share *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, share, before in reversed(trail):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + share
            total -= length * share
    return chosen


def make_plan(histogram: dict[int, int], window: int) -> Plan:
    """Plan for ``histogram`` (count by length, 1..window).  A step fills windows
    without slack or retires the longest length to the stream, so the plan has a
    few ranges per length, however many pieces there are."""
    plan = Plan(window, {k: [] for k in histogram})
    counts = {k: n for k, n in histogram.items() if n}
    used, stream = dict.fromkeys(histogram, 0), {}
    while counts:
        top = max(counts)
        rest = counts | {top: counts[top] - 1}
        chosen = fill({k: n for k, n in rest.items() if n}, window - top) if top < window else {}
        chosen[top] = chosen.get(top, 0) + 1
        if sum(k * m for k, m in chosen.items()) < window:
            stream[top] = counts.pop(top)
            continue
        times, offset = min(counts[k] // m for k, m in chosen.items()), 0
        for k in sorted(chosen, reverse=True):
            m = chosen[k]
            plan.ranges[k].append(Range(used[k], plan.sequences, m, offset))
            used[k] += m * times
            offset += k * m
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
        plan.sequences += times
    tokens = 0
    for k, n in stream.items():
        plan.ranges[k].append(Range(used[k], plan.sequences, 1, tokens, True))
        tokens += k * n
    plan.sequences += -(-tokens // window)
    return plan


def place(plan: Plan, length: int, rank: np.ndarray) -> list[tuple]:
    """Where tails of ``length`` go: (which, start, size, sequence, offset)
    arrays; the windows of the stream cut a tail at most once."""
    ranges, out = plan.ranges[length], []
    at = np.searchsorted(np.array([r.lo for r in ranges]), rank, side="right") - 1
    for i in np.unique(at):
        r, which = ranges[i], np.flatnonzero(at == i)
        k = rank[which] - r.lo
        if not r.stream:
            out.append((which, 0, length, r.first + k // r.per, r.offset + k % r.per * length))
            continue
        token = r.offset + k * length
        seq, off = r.first + token // plan.window, token % plan.window
        head = np.minimum(length, plan.window - off)
        out.append((which, 0, head, seq, off))
        cut = head < length
        out.append((which[cut], head[cut], length - head[cut], seq[cut] + 1, 0))
    return out


# ---- operator ---------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, id_col: str = "doc_id", text: str = "text", ids: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Pieces of ``docs`` in sequences of at most ``window`` tokens: the ``carry``
    columns (the id by default), row_id (one per row of ``docs``), start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``ids`` the piece's ids as little-endian bytes.

    Null text counts as empty: one piece with the end id.  Repeated rows are
    packed each on its own.  Ids may be null.  An empty table gives no piece.
    Columns outside ``carry`` are ignored.  ``tokenizer`` is the path of a
    tokenizer file that every worker can read.
    """
    import os

    import tokenizers  # noqa: F401  fails early where it is missing

    spark, carry = docs.sparkSession, carry or [id_col]
    kept = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    bare = [*carry, "row_id"]
    cut = docs.select(*carry).schema.add("row_id", "long").add("_start", "long").add("_length", "integer").add("_total", "long").add("_ids", "binary").add("_task", "integer").add("_rank", "long")

    def tokenize(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, seen, enc = TaskContext.get().partitionId(), [0] * (window + 1), Encoder(tokenizer)
        end, row = pack_ids([END_ID]), task << 33
        for batch in portions(batches, "__text"):
            rows, starts, lengths, totals, blobs, ranks = [], [], [], [], [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                blob = enc.encode(t) + end
                total = len(blob) // 4
                for s in range(0, total, window):
                    n = min(window, total - s)
                    rows.append(i)
                    starts.append(s)
                    lengths.append(n)
                    totals.append(total)
                    blobs.append(squeeze(blob[4 * s : 4 * (s + n)]))
                    ranks.append(seen[n])
                    seen[n] += 1
            new = {"row_id": pa.array(np.array(rows, np.int64) + row), "_start": pa.array(starts, pa.int64()), "_length": pa.array(lengths, pa.int32()), "_total": pa.array(totals, pa.int64())}
            new |= {"_ids": pa.array(blobs, pa.binary()), "_task": pa.array([task] * len(rows), pa.int32()), "_rank": pa.array(ranks, pa.int64())}
            yield extend(batch, "__text", new, rows)
            row += batch.num_rows

    pieces = materialize(kept.mapInArrow(tokenize, cut))
    per_task = pieces.groupBy("_length", "_task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("_length", "_task", F.coalesce(before, F.lit(0)).alias("_before"), "n")
    offsets = materialize(offsets)
    histogram = {r["_length"]: r["n"] for r in offsets.groupBy("_length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, window)  # at most `window` lengths came in
    shared = spark.sparkContext.broadcast(plan)
    result = docs.select(*carry).schema.add("row_id", "long").add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    result = result.add("ids", "binary") if ids else result

    def assign(batches):
        from zlib import crc32

        import pyarrow as pa

        plan = shared.value
        for batch in portions(batches, "_ids"):
            rank = batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()
            length = batch.column("_length").to_numpy()
            parts = []
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                parts += [(mine[which], *np.broadcast_arrays(start, size, seq, off, which)[:4]) for which, start, size, seq, off in place(plan, int(n), rank[mine])]
            if not parts:
                continue
            row, at, size, seq, off = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
            whole, blobs = batch.column("_ids").to_pylist(), []
            for i, a, n in zip(row.tolist(), at.tolist(), size.tolist()):
                blobs.append(spread(whole[i])[4 * a : 4 * (a + n)])
            new = {"start": batch.column("_start").to_numpy()[row] + at, "length": size, "ids_crc32": np.fromiter(map(crc32, blobs), np.int64, len(blobs))}
            new |= {"doc_tokens": batch.column("_total").to_numpy()[row], "sequence_id": seq, "offset": off}
            columns = {k: pa.array(v, pa.int64()) for k, v in new.items()}
            if ids:
                columns["ids"] = pa.array(blobs, pa.binary())
            yield extend(batch.select(bare), "", columns, row)

    return pieces.join(offsets.drop("n"), ["_length", "_task"]).mapInArrow(assign, result)


def squeeze(blob: bytes) -> bytes:
    """Ids in two bytes each, after a mark, where all of them fit."""
    a = np.frombuffer(blob, "<u4")
    return b"2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 65536 else b"4" + blob


def spread(blob: bytes) -> bytes:
    return blob[1:] if blob[:1] == b"4" else np.frombuffer(blob, "<u2", offset=1).astype("<u4").tobytes()
