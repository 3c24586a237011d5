"""Digests, hex, compression, serialisation and AES-256 in counter mode."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.expr import col


def md5(a) -> Column:
    return F.md5(col(a).cast("binary"))


def sha1(a) -> Column:
    return F.sha1(col(a).cast("binary"))


def sha2(a) -> Column:
    return F.sha2(col(a).cast("binary"), 256)


def to_hex(a) -> Column:
    return F.lower(F.hex(col(a).cast("binary")))


def from_hex(a) -> Column:
    """Bytes of a hex string; odd lengths are a length error."""
    a = col(a)
    return F.when(F.length(a) % 2 != 0, F.raise_error(F.lit("length")).cast("binary")).otherwise(F.unhex(a))


def _each(fn, a) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: fn(bytes(b)), na_action="ignore")

    return run(a)


def compress(a) -> Column:
    return _each(zlib.compress, col(a).cast("binary"))


def decompress(a) -> Column:
    return _each(zlib.decompress, col(a))


def serialize(a) -> Column:
    """Any value as JSON bytes, wrapped so that atoms keep their type on return."""
    return F.to_json(F.struct(col(a).alias("v"))).cast("binary")


def deserialize(a, kind: str) -> Column:
    return F.from_json(col(a).cast("string"), f"v {kind}")["v"]


def printable(a, kind: str) -> Column:
    """Text that reads as the value in the notation, ``kind`` being its Spark type:
    numbers of a list stand side by side, one alone behind a comma, other lists in
    brackets; text is quoted."""
    from quiver.functions.text import significant

    a = col(a)
    if kind.startswith("array<"):
        inner = kind[6:-1]
        simple_ = inner in ("int", "bigint", "double", "float")
        items = F.transform(a, lambda x: printable(x, inner))
        some = F.array_join(items, " ") if simple_ else F.concat(F.lit("("), F.array_join(items, ";"), F.lit(")"))
        none = F.lit({"int": "!0", "bigint": "!0", "double": "0#0.0", "float": "0#0.0"}.get(inner, "()"))
        return F.when(F.size(a) == 0, none).when(F.size(a) == 1, F.concat(F.lit(","), F.get(items, 0))).otherwise(some)
    if kind == "string":
        return F.concat(F.lit('"'), F.regexp_replace(a, r'(["\\\\])', r"\\$1"), F.lit('"'))
    if kind in ("double", "float"):
        return F.when(F.isnan(a) | a.isNull(), F.lit("0n")).otherwise(significant(a, 7))
    return F.coalesce(a.cast("string"), F.lit("0N"))


#: Widths of codes, the code that clears the table, and its size.
NARROW, WIDE, CLEAR, TABLE = 9, 12, 256, 4096
#: Codes between two clears, the clearing one included, and the single bytes.
ROUND, SINGLE = TABLE - CLEAR + 1, [bytes([i]) for i in range(256)] + [b""]


def _places():
    """Widths and ends in bits of the codes of two rounds, after which a byte is full:
    a code's width follows from its place alone."""
    following = np.append(np.arange(CLEAR + 1, TABLE + 1), TABLE)
    widths = np.tile(NARROW + sum((following > 1 << w).astype(int) for w in range(NARROW, WIDE)), 2)
    return widths, widths.cumsum()


_WIDTHS, _ENDS = _places()
_BITS = np.arange(WIDE, dtype=np.int32)
_USED = _BITS < _WIDTHS[:, None]


def _packed(keys: list[int]) -> bytes:
    """The codes of at most two rounds, each above the eight bits of a next byte."""
    codes = np.array(keys, np.int32) >> 8
    bits = (codes[:, None] >> _BITS & 1).astype(np.uint8)[_USED[: len(codes)]]
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_table() -> list[int]:
    """An empty table of the packer: by code and next byte, the longer run's code."""
    return [0] * (TABLE << 8)


def lzw_pack(data: bytes, table: list[int] | None = None) -> bytes:
    """Codes of growing width for the longest runs met before; a full table is
    cleared.  The length of the data goes ahead, in four bytes.  Codes are held
    shifted by a byte; a given table comes empty and is left empty."""
    out, keys, start, full = bytearray(len(data).to_bytes(4, "little")), [], CLEAR + 1 << 8, TABLE << 8
    if not data:
        return bytes(out)
    table, put, following = lzw_table() if table is None else table, keys.append, start
    rest = iter(data)
    run = next(rest) << 8
    for byte in rest:
        key = run | byte
        longer = table[key]
        if longer:
            run = longer
            continue
        put(key)
        if following < full:
            table[key] = following
            following += 256
        else:
            put(CLEAR << 8)
            for key in keys[-ROUND:]:
                table[key] = 0
            following = start
            if len(keys) == 2 * ROUND:
                out += _packed(keys)
                keys.clear()
        run = byte << 8
    for key in keys[-ROUND:]:
        table[key] = 0
    put(run)
    return bytes(out + _packed(keys))


def lzw_unpack(blob: bytes) -> bytes:
    size, whole, parts = int.from_bytes(blob[:4], "little"), int(_ENDS[-1]) // 8, []
    for at in range(4, len(blob), whole):
        piece = blob[at : at + whole]
        n = int(_ENDS.searchsorted(8 * len(piece), "right"))
        held, starts = np.frombuffer(piece + bytes(2), np.uint8).astype(np.int32), _ENDS[:n] - _WIDTHS[:n]
        byte = starts >> 3
        codes = ((held[byte] | held[byte + 1] << 8 | held[byte + 2] << 16) >> (starts & 7) & (1 << _WIDTHS[:n]) - 1).tolist()
        for first in range(0, n, ROUND):
            some = codes[first : first + ROUND - 1]
            table = SINGLE.copy()
            learn, before = table.append, table[some[0]]
            for code in some[1:]:
                try:
                    run = table[code]
                except IndexError:  # the run that is just being learnt
                    run = before + before[:1]
                learn(before + run[:1])
                before = run
            parts += map(table.__getitem__, some)
    out = b"".join(parts)
    if len(out) != size:
        raise ValueError("length")
    return out


def lzw(a) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        table = lzw_table()
        return s.map(lambda b: lzw_pack(bytes(b), table), na_action="ignore")

    return run(col(a).cast("binary"))


def unlzw(a) -> Column:
    return _each(lzw_unpack, col(a))


def aes_ctr(a, key_hex: str, iv_hex: str) -> Column:
    """AES-256-CTR of bytes (its own inverse): the keystream is the ECB image of
    a 128-bit big-endian counter from the iv, combined byte by byte."""
    data, start = F.hex(col(a).cast("binary")), int(iv_hex, 16)
    blocks = F.ceil(F.octet_length(col(a).cast("binary")) / 16).cast("int")
    high, low = start >> 64, start & (2**64 - 1)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    index = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))

    def block(i: Column) -> Column:
        at = F.lit(signed(low)) + i.cast("long")
        over = ((F.lit(signed(low)) < 0) & (at >= 0)).cast("long")
        words = F.concat(F.lpad(F.hex(F.lit(signed(high)) + over), 16, "0"), F.lpad(F.hex(at), 16, "0"))
        return F.substring(F.hex(F.aes_encrypt(F.unhex(words), F.unhex(F.lit(key_hex)), F.lit("ECB"), F.lit("PKCS"))), 1, 32)

    stream = F.array_join(F.transform(index, block), "")
    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda s, p: F.conv(F.substring(s, p, F.lit(2)), 16, 10).cast("int")
    mixed = F.transform(places, lambda p: F.lpad(F.lower(F.hex(byte(data, p).bitwiseXOR(byte(stream, p)).cast("long"))), 2, "0"))
    return F.array_join(mixed, "")
