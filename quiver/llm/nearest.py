"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into slabs; each pair of slabs is one tile, an
equi-joined group of bounded size.  In a tile both sides are quantised to int8
per vector; the product of the int8 blocks, with the quantisation error of both
sides, bounds every squared distance from below and above.  Pairs whose lower
bound is above the k-th smallest upper bound of their query cannot be among its
nearest and go; the others are recomputed in double precision on the original
vectors.  A query's short sorted lists from its tiles are merged by a heap.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import materialize
from quiver.llm.vectors import matrix, packed

#: Rows of a candidate and of a query slab, and bytes of either.
CANDIDATES, QUERIES, SLAB_BYTES = 65_536, 8_192, 64 << 20
#: Candidates and queries of a block inside a tile.
ROWS, HEADS = 4_096, 1_024
#: Pairs that a block of queries keeps before it works out their distances.
PAIRS = 1 << 20


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error): x = scale * codes + rest, |rest| = error, row by row;
    rows too small for a scale have zero codes."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.where(scale > 1e-140, scale, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def exponent(x: np.ndarray) -> np.ndarray:
    """Per row, the power of two above its largest component."""
    return np.frexp(np.abs(x).max(axis=1))[1]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added in order; where squares could leave the range of
    doubles, under powers of two, which are exact."""
    if not len(a):
        return np.zeros(0)
    if max(np.abs(a).max(), np.abs(b).max()) < 1e150:
        gap = np.ascontiguousarray((a - b).T)
        top = np.abs(gap).max(axis=0)
        if ((top == 0) | (top > 1e-140)).all():
            return np.sqrt(squares(gap))
    e = np.maximum(exponent(a), exponent(b)) + 1
    gap = np.ldexp(a, -e[:, None]) - np.ldexp(b, -e[:, None])
    small = exponent(gap)
    with np.errstate(over="ignore"):
        return np.ldexp(np.sqrt(squares(np.ldexp(gap, -small[:, None]).T)), small + e)


def squares(gap: np.ndarray) -> np.ndarray:
    """Sum of the squared rows, one after the other."""
    total = np.zeros(gap.shape[1])
    for g in gap:
        total += g * g
    return total


def tile_nearest(quid: np.ndarray, q: np.ndarray, cuid: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, distance) of the k nearest of each
    query among the rows other than its own."""
    top = int(max(exponent(q).max(), exponent(c).max()))
    qs_, cs_ = np.ldexp(q, -top), np.ldexp(c, -top)  # components of at most 1 bound the squares
    cc, cs, ce = quantise(cs_)
    # float32 adds products of int8 codes exactly up to 1040 dimensions; doubles hold the rest
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    cn, codes = (cs_ * cs_).sum(axis=1), cc.astype(kind)
    c_hat = np.sqrt(cn) + ce
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for head in range(0, len(q), HEADS):
        rows = slice(head, min(len(q), head + HEADS))
        qc, qs, qe = quantise(qs_[rows])
        qn = (qs_[rows] * qs_[rows]).sum(axis=1)
        q_hat, qc = np.sqrt(qn) + qe, qc.astype(kind)
        cut = np.full(len(qn), np.inf)
        keep: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        worst = np.full(len(qn), np.inf)

        def settle(best):
            """The k nearest of what was found and what is kept, in doubles."""
            i, j, low = (np.concatenate(x) for x in zip(*keep))
            keep.clear()
            ok = low <= cut[i]
            i, j = i[ok], j[ok]
            d = np.concatenate([np.zeros(0), *(distance(q[head + i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536))])
            ok = d <= worst[i]
            i, j, d = (np.concatenate(x) for x in zip(best, (i[ok], j[ok], d[ok])))
            order = np.lexsort((cuid[j], cid[j], d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == k - 1
            worst[i[last]] = d[last]
            cut[i[last]] = np.minimum(cut[i[last]], np.ldexp(d[last], -top) ** 2 * (1 + 1e-9) + 1e-280)
            return i[place < k], j[place < k], d[place < k]

        for a in range(0, len(c), ROWS):
            b = min(len(c), a + ROWS)
            near = qn[:, None] + cn[None, a:b] - 2 * ((qc @ codes[a:b].T) * qs[:, None] * cs[None, a:b])
            # q.c differs from the product of codes by at most |q||c rest| + |q rest||c| + |q rest||c rest|
            slack = 2 * (q_hat[:, None] * ce[None, a:b] + qe[:, None] * c_hat[None, a:b]) + 1e-6 * (qn[:, None] + cn[None, a:b]) + 1e-280
            same = quid[rows][:, None] == cuid[None, a:b]
            upper = np.where(same, np.inf, near + slack)
            if b - a >= k:
                cut = np.minimum(cut, np.partition(upper, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(~same & (near - slack <= cut[:, None]))
            keep.append((i, j + a, (near - slack)[i, j]))
            if sum(len(x[0]) for x in keep) > PAIRS:  # dense neighbourhoods leave many pairs
                best = settle(best)
        if keep:
            best = settle(best)
        out.append((best[0] + head, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the ``k`` nearest
    other rows of each row of ``vectors`` where ``is_query`` (a condition) holds;
    ties go to the smaller id.

    Null and zero vectors and those with null or non-finite components take no part,
    nor do null ids.  With fewer than ``k`` candidates all are returned.  Rows with a
    repeated id are queries and candidates each on its own, so their ids may
    come more than once.  Vectors of another length than the query's are not compared.
    Magnitudes may be any: bounds and distances are worked out under powers of two.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    c = packed(vectors.withColumn("__q", F.expr(is_query) if isinstance(is_query, str) else is_query), id_col, vec_col, "__q").where("id is not null")
    c = materialize(c.withColumn("uid", F.monotonically_increasing_id()))
    q = c.where("__q")
    n_c, width = c.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(8))).first()
    n_q = q.count()
    most = lambda rows: max(1, min(rows, SLAB_BYTES // max(8, width)))
    slabs_c, slabs_q = max(1, -(-n_c // most(CANDIDATES))), max(1, -(-n_q // most(QUERIES)))
    # enough tiles for every core, while each stays a block product
    slabs_c = max(slabs_c, min(-(-n_c // 512), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slab = lambda n: F.pmod(F.xxhash64("uid", F.lit(n)), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(*[F.col(x).alias(f"q_{x}") for x in ("uid", "id", "v", "kind")], slab(slabs_q).alias("qs"), across(slabs_c).alias("cs"))
    right = c.select("uid", "id", "v", "kind", slab(slabs_c).alias("c_s"), across(slabs_q).alias("q_s"))
    columns = ["query_uid", "query_id", "tile", "uid", "vec_id", "score"]

    def tile(key, left, right):
        parts = []
        for size, part in left.groupby(left["q_v"].map(len)):
            # of equal vectors the k + 1 first, one of which may be the query's own
            other = right[right["v"].map(len) == size].sort_values(["id", "uid"]).groupby("v", sort=False).head(k + 1)
            if len(other):
                quid, qid, kq, kc = part["q_uid"].to_numpy(), part["q_id"].to_numpy(), part["q_kind"].iloc[0], other["kind"].iloc[0]
                uid, ids = other["uid"].to_numpy(), other["id"].to_numpy()
                i, j, d = tile_nearest(quid, matrix(part["q_v"], kq), uid, ids, matrix(other["v"], kc), k)
                parts.append(pd.DataFrame(dict(zip(columns, (quid[i], qid[i], key[1], uid[j], ids[j], d)))))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: np.zeros(0) for n in columns})

    found = left.groupBy("qs", "cs").cogroup(right.groupBy("q_s", "c_s")).applyInPandas(tile, "query_uid long, query_id long, tile int, uid long, vec_id long, score double")
    # lists of one query meet in one group of queries: at most k rows of each candidate slab
    share = F.pmod(F.xxhash64("query_uid"), F.lit(max(1, n_q // 64))).alias("share")

    def merge(pdf):
        rows = []
        pdf = pdf.sort_values(["query_uid", "tile", "score", "vec_id", "uid"])
        for _, part in pdf.groupby("query_uid", sort=True):
            lists = [list(zip(x["score"], x["vec_id"], x["uid"], x["query_id"])) for _, x in part.groupby("tile")]
            for rank, (score, vec, _, query) in zip(range(1, k + 1), heapq.merge(*lists)):
                rows.append((query, rank, vec, score))
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return found.groupBy(share).applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
