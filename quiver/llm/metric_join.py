"""Near-duplicate vectors by an exact metric range join.

Cosine >= t between vectors is Euclidean distance <= r = sqrt(2 - 2t) between
their unit vectors.  Distinct vectors stand for their copies.  Pivots, sampled
from the vectors and at least r apart, split space into the cells of the nearest
pivot.  By the triangle inequality a vector can have a partner in cell j only if it
lies within r of the border to it, (x - m).(p_home - p_j) / |p_home - p_j| <= r with
m their midpoint; it is replicated to those cells (of smaller number than its
own, so a pair meets in one cell).  Cells join independently, in chunks of bounded
bytes: a block product finds candidates with a margin for its rounding, each is
checked in double precision on the original components.  A chunk pair reports link
counts per vector and a star per local component; no pair of the join is a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import connected_components, discard, materialize
from quiver.llm.simhash_dedup import local_roots
from quiver.llm.vectors import cosine, matrix, packed, unit, usable

#: Vectors of a home chunk, and of a chunk that meets it, and bytes of either.
HOME, GUEST, CHUNK_BYTES = 8_192, 16_384, 32 << 20
#: Vectors whose places are worked out at once, and pairs compared at once.
ROWS, PAIRS = 1_024, 1 << 21


def apart(p: np.ndarray, least: float) -> np.ndarray:
    """The rows, in order, that lie at least ``least`` from every row taken before."""
    taken: list[int] = []
    for i in range(len(p)):
        if not taken or ((p[taken] - p[i]) ** 2).sum(axis=1).min() >= least * least:
            taken.append(i)
    return p[taken]


def border_distance(x: np.ndarray, p: np.ndarray, home: np.ndarray) -> np.ndarray:
    """How far each row of x lies on its home pivot's side of the border to every pivot."""
    out = np.empty((len(x), len(p)))
    for h in np.unique(home):
        gap = p[h] - p  # from the difference itself: exact however close the pivots are
        between = np.sqrt((gap * gap).sum(axis=1))
        middle = (((p[h] + p) / 2) * gap).sum(axis=1)
        at = home == h
        out[at] = (x[at] @ gap.T - middle) / np.where(between > 0, between, 1.0)
    return out


def chunk_links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, t: float, triangle: bool):
    """Links of home rows ``a`` and guests ``b`` (the same rows with ``triangle``)
    of ``na`` and ``nb`` copies: (links of each a, links of each b, component
    root of each row of a then b)."""
    ua, ub = unit(a).astype(np.float32), unit(b).astype(np.float32)
    margin = 1e-5 + 1e-6 * math.sqrt(a.shape[1])
    la, lb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    root = np.arange(len(a) if triangle else len(a) + len(b))
    step = max(1, min(512, PAIRS // max(1, len(b))))
    for s in range(0, len(a), step):
        dots = ua[s : s + step] @ ub.T
        i, j = np.nonzero(dots >= t - margin)
        i += s
        if triangle:
            i, j = i[i < j], j[i < j]
        unsure = dots[i - s, j] < t + margin
        if unsure.any():
            ok = ~unsure
            at = np.flatnonzero(unsure)
            for x in range(0, len(at), 65536):
                part = at[x : x + 65536]
                ok[part] = cosine(a[i[part]], b[j[part]]) >= t
            i, j = i[ok], j[ok]
        la += np.bincount(i, nb[j], len(a)).astype(np.int64)
        lb += np.bincount(j, na[i], len(b)).astype(np.int64)
        u, v = root[i], root[j if triangle else j + len(a)]
        new = u != v  # links inside a component already known are counted and go
        if new.any():
            root = local_roots(len(root), u[new], v[new])[root]
    return la, lb, root


def similarity_join(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, seed: int = 42) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links join rows of cosine >= ``threshold`` (double precision), each row with
    every other, copies included.  Null and zero vectors, and those with null or
    non-finite components, link with nothing: n_links 0 and their own id.
    Vectors of different lengths do not link.  Rows with a repeated id are rows
    of their own; null ids are larger than any other.  ``kept`` marks the row of
    a component's smallest id.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = materialize(packed(vectors, id_col, vec_col))
    # one row per distinct vector; its number is its class
    classes = good.groupBy("v", "kind").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    k = pivots or max(1, min(4096, math.ceil(math.sqrt(n) / 8)))
    picked = classes.orderBy(F.xxhash64("v", F.lit(seed)), "cls").limit(k).select("v", "kind").toPandas()
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    by_width = {int(w): apart(unit(matrix(p["v"].tolist(), p["kind"].iloc[0])), max(r, 1e-4)) for w, p in picked.groupby(picked["v"].map(len))}
    shared = spark.sparkContext.broadcast(by_width)  # at most 4096 vectors

    def places(pdf):
        """(row, width, cell, home) of each vector at home and in the cells it
        must visit; a length without pivots is a cell of its own."""
        widths, out = pdf["v"].map(len).to_numpy(), []
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            p = shared.value.get(int(width))
            if p is None:
                out.append((at, np.full(len(at), width), np.zeros(len(at), np.int64), np.ones(len(at), bool)))
                continue
            x = unit(matrix(pdf["v"].iloc[at].tolist(), pdf["kind"].iloc[0]))
            home = (x @ p.T).argmax(axis=1)
            border = border_distance(x, p, home)
            i, c = np.nonzero((border <= r + 1e-6) & (np.arange(len(p))[None, :] < home[:, None]))
            out.append((at, np.full(len(at), width), home, np.ones(len(at), bool)))
            out.append((at[i], np.full(len(i), width), c, np.zeros(len(i), bool)))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("row", "width", "cell", "home"), zip(*out))})

    def bounded(batches):
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                yield pdf.iloc[a : a + ROWS].reset_index(drop=True)

    def tally(batches):
        for pdf in bounded(batches):
            yield places(pdf).groupby(["width", "cell"], as_index=False).agg(own=("home", "sum"), every=("home", "size"))

    def deal(batches):
        for pdf in bounded(batches):
            got = places(pdf)
            yield pd.concat([pdf.iloc[got["row"].to_numpy()].reset_index(drop=True), got.drop(columns="row")], axis=1)

    sizes = classes.select("v", "kind").mapInPandas(tally, "width int, cell long, own long, every long")
    sizes = sizes.groupBy("width", "cell").agg(F.sum("own").alias("own"), (F.sum("every") - F.sum("own")).alias("out"))
    most = lambda rows: F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(CHUNK_BYTES) / F.col("width"))))
    sizes = sizes.select("width", "cell", F.greatest(F.ceil(F.col("own") / most(HOME)), F.lit(1)).cast("int").alias("hc"), F.ceil(F.col("out") / most(GUEST)).cast("int").alias("gc"))
    placed = classes.select("cls", "copies", "v", "kind").mapInPandas(deal, "cls long, copies long, v binary, kind string, width int, cell long, home boolean")
    # a row per cell, of which there are no more than pivots and vector lengths
    shared_sizes = materialize(sizes)
    chunked = placed.join(F.broadcast(shared_sizes), ["width", "cell"])
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("cls"), F.col("hc"))).otherwise(F.pmod(F.xxhash64("cls"), F.greatest("gc", F.lit(1)))).cast("int")
    chunked = chunked.withColumn("mine", mine)
    # tasks (h, o): home chunk h with home chunk o >= h, or with guest chunk hc + o
    as_home = F.transform(F.filter(F.sequence(F.lit(0), F.col("hc") + F.col("gc") - 1), lambda o: (o >= F.col("mine"))), lambda o: F.struct(F.col("mine").alias("h"), o.alias("o"), F.lit(0).alias("side")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("mine")), lambda h: F.struct(h.alias("h"), F.col("mine").alias("o"), F.lit(1).alias("side")))
    as_other = F.filter(as_other, lambda x: x["h"] < x["o"])
    as_guest = F.transform(F.sequence(F.lit(0), F.col("hc") - 1), lambda h: F.struct(h.alias("h"), (F.col("hc") + F.col("mine")).alias("o"), F.lit(1).alias("side")))
    tasks = F.when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_guest)
    dealt = chunked.withColumn("t", F.explode(tasks)).select("width", "cell", "t.h", "t.o", "t.side", "cls", "copies", "v", "kind")

    def join(pdf):
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        triangle = not len(b) and pdf["h"].iloc[0] == pdf["o"].iloc[0]
        empty = pd.DataFrame({"cls": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(a) or (not len(b) and not triangle):
            return empty
        b = a if triangle else b
        la, lb, root = chunk_links(matrix(a["v"].tolist(), a["kind"].iloc[0]), matrix(b["v"].tolist(), a["kind"].iloc[0]), a["copies"].to_numpy(), b["copies"].to_numpy(), threshold, triangle)
        cls = a["cls"].to_numpy() if triangle else np.concatenate([a["cls"], b["cls"]])
        links = la + lb if triangle else np.concatenate([la, lb])
        some = links > 0
        return pd.DataFrame({"cls": cls[some], "links": links[some], "root": cls[root[some]]})

    found = dealt.groupBy("width", "cell", "h", "o").applyInPandas(join, "cls long, links long, root long")
    found = materialize(found)
    discard(shared_sizes)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.drop("kind").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    was, named = classes, materialize(named.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    discard(was, found)
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(heads, "root").select("v", "n_links", F.col("component_id"))
    told = good.select(F.col("id").alias("vec_id"), "v").join(answer, "v").drop("v")
    # rows whose vector links with nothing are their own answer
    alone = vectors.select(F.col(id_col).cast("long").alias("vec_id"), usable(vec_col).alias("fine")).where("not fine")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = told.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
