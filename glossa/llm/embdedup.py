"""Embedding near duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c have a squared distance of at most 2 - 2c.
After a fixed rotation (random signs and a Walsh-Hadamard transform, twice) the
coordinates are split into blocks; a pair within the distance has at least
one block within the budget that is proportional to the block's dimension.
Each block is range-joined: a grid over its first ``GRID`` coordinates with
cells twice the block's radius wide; a vector goes to its own cell and to those
later cells that its ball reaches.  Within a cell, pairs inside the block's
budget are candidates; a pair counts in the first block that admits it, so the
union over blocks has no repeats, and the cosine of the given vectors in double
precision decides.

A cell with many vectors is cut into tiles of at most about ``TILE`` x ``TILE``
vectors.  A tile returns the number of links of each of its vectors and a
spanning forest of the links, never the pairs: its output has at most one row
for each vector.  Equal vectors are one class with one entry.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths don't link; a null
id takes no part in links (n_links 0, component null, kept); rows that repeat an
id are one node, and count as one vector each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, spread_join
from glossa.llm.components import connected_components

BLOCK, GRID, TILE = 16, 2, 16_384
#: Slack on distances for rounding; candidates are checked exactly anyway.
EPS = 1e-9


@lru_cache(8)
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(97).choice([-1.0, 1.0], (2, width))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (exact) that brings the largest component to
    about 1, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length and rotated, as float64.  All steps are
    elementwise or per row, so a vector's result never depends on its batch."""
    x = _scaled(x)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    width = max(BLOCK, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    for s in _signs(width):
        y = y * s
        h = 1
        while h < width:
            z = y.reshape(len(y), -1, 2, h)
            y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(len(y), width)
            h *= 2
        y = y / np.sqrt(width)
    return y


def _cells(y: np.ndarray, limit: float):
    """(rows, block, cell, own) of a batch of rotated vectors; ``limit`` is the
    squared distance of the join."""
    blocks = y.shape[1] // BLOCK
    r = np.sqrt(limit / blocks) + EPS
    for b in range(blocks):
        g = y[:, b * BLOCK:b * BLOCK + GRID] / (2 * r)
        home = np.floor(g).astype(np.int64)
        inside = g - home                                    # in cell widths; a ball's radius is 0.5
        code = lambda c: ((c + (1 << 19)) << (20 * np.arange(GRID))).sum(axis=1)
        own = code(home)
        yield np.arange(len(y)), b, own, True
        gap = np.stack([inside, np.zeros_like(inside), 1 - inside], axis=2)   # to step -1, 0, +1
        for step in np.ndindex(*(3,) * GRID):
            d = np.array(step) - 1
            first = d[np.nonzero(d)[0][0]] if d.any() else 0
            if first <= 0:
                continue                                    # later cells only
            far = sum(gap[:, i, step[i]] ** 2 for i in range(GRID))
            rows = np.nonzero(far <= 0.25 + EPS)[0]
            if len(rows):
                yield rows, b, code(home[rows] + d), False


def _entries(batches, limit, tiles):
    """Rows of the tiles.  ``tiles`` maps (length, block, cell) of crowded cells
    to their number of cuts; None: only count, a row per vector and cell."""
    for batch in batches:
        ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lens = np.diff(vecs.offsets.to_numpy())
        for width in np.unique(lens):
            at = np.nonzero(lens == width)[0]
            x = vecs.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)
            raw = pa.array([r.tobytes() for r in x], pa.binary())   # as given: float or double
            x = x.astype(np.float64)
            parts = []
            for rows, b, cell, own in _cells(rotate(x), limit):
                if tiles is None:
                    c, n = np.unique(cell, return_counts=True)
                    parts.append(pd.DataFrame({"width": int(width), "block": b, "cell": c, "n": n}))
                    continue
                cuts = np.array([tiles.get((int(width), b, int(c)), 1) for c in cell])
                part = (ids[at[rows]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % cuts
                if own:     # on the left of every tile of its row, on the right of the earlier cuts' tiles
                    for k in range(cuts.max()):
                        for i, j, left in ((part, np.full_like(part, k), True), (np.full_like(part, k), part, False)):
                            m = (k < cuts) if left else (k < part)
                            parts.append(pd.DataFrame({"width": int(width), "block": b, "cell": cell[m], "i": i[m],
                                                       "j": j[m], "at": rows[m], "left": left}))
                else:
                    for k in range(cuts.max()):
                        m = k < cuts
                        parts.append(pd.DataFrame({"width": int(width), "block": b, "cell": cell[m], "i": k,
                                                   "j": part[m], "at": rows[m], "left": False}))
            out = pd.concat(parts, ignore_index=True)
            if tiles is None:
                out = out.groupby(["width", "block", "cell"], as_index=False).n.sum()
                yield pa.RecordBatch.from_pandas(out.astype("int64"), preserve_index=False)
                continue
            for a in range(0, len(out), 20_000):
                o = out.iloc[a:a + 20_000]
                pick = pa.array(at[o["at"].to_numpy()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o[c].to_numpy(), pa.int64()) for c in ("width", "block", "cell", "i", "j")]
                    + [pa.array(o["left"].to_numpy()), batch.column(0).take(pick),
                       raw.take(pa.array(o["at"].to_numpy())), batch.column(2).take(pick)],
                    ["width", "block", "cell", "i", "j", "left", "id", "vec", "weight"])


def _first_block(diff2: np.ndarray, budget: float) -> np.ndarray:
    within = diff2.reshape(len(diff2), -1, BLOCK).sum(axis=2) <= budget + EPS
    return np.where(within.any(axis=1), within.argmax(axis=1), -1)


def _tile(pdf: pd.DataFrame, limit: float, cosine: float, kind: str) -> pd.DataFrame:
    """Links among the vectors of one tile: for each linked vector the weight of
    its partners and the smallest id of its component here."""
    x = _scaled(np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1).astype(np.float64))
    y, b = rotate(x), int(pdf["block"].iloc[0])
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    budget = limit / (y.shape[1] // BLOCK)
    sub = np.ascontiguousarray(y[:, b * BLOCK:(b + 1) * BLOCK], np.float32)
    sq = np.einsum("ij,ij->i", sub, sub)
    ids, w = pdf["id"].to_numpy(), pdf["weight"].to_numpy()
    left = np.nonzero(pdf["left"].to_numpy())[0]      # home vectors of cut i
    right = np.nonzero(~pdf["left"].to_numpy())[0]    # home vectors of cut j, and those that reach in
    same = int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0])
    label = np.arange(len(x))
    count = np.zeros(len(x), np.int64)

    def join(p, q):
        """Candidates p, q (indices): count links, join components."""
        d = y[p] - y[q]
        ok = _first_block(d * d, budget) == b
        p, q = p[ok], q[ok]
        cos = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q])
        ok = cos >= cosine
        p, q = p[ok], q[ok]
        np.add.at(count, p, w[q])
        np.add.at(count, q, w[p])
        while True:
            lo = np.minimum(label[p], label[q])
            if (lo == label[p]).all() and (lo == label[q]).all():
                return
            np.minimum.at(label, label[p], lo)
            np.minimum.at(label, label[q], lo)
            label[:] = label[label]

    targets = [(right, False)] + ([(left, True)] if same else [])
    for other, upper in targets:
        if not len(other):
            continue
        for a in range(0, len(left), 256):
            rows = left[a:a + 256]
            near = sq[rows, None] + sq[other] - 2 * (sub[rows] @ sub[other].T) <= budget + 1e-5
            if upper:
                near &= other[None, :] > rows[:, None]
            p, q = np.nonzero(near)
            for c in range(0, len(p), 100_000):
                join(rows[p[c:c + 100_000]], other[q[c:c + 100_000]])
    while (label[label] != label).any():
        label[:] = label[label]
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    hit = count > 0
    out = pd.DataFrame({"id": ids[hit], "n": count[hit], "root": least[label[hit]]})
    return out.groupby(["id", "root"], as_index=False).n.sum()[["id", "n", "root"]]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                    cosine: float = 0.95) -> DataFrame:
    """A row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    limit = 2 - 2 * cosine
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vec"))
    if v.schema["vec"].dataType.elementType.typeName() not in ("float", "double"):
        v = v.withColumn("vec", F.col("vec").cast("array<double>"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("vec", F.when(F.col("id").isNotNull() & fine, F.col("vec")))
    classes = scratch.keep(v.where("vec IS NOT NULL").groupBy("vec").agg(
        F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "vec", "weight"), "classes")
    # only classes of several rows have another representative than the row itself
    shared = classes.where("weight > 1").select(F.col("id").alias("rep"), "vec", "weight")
    members = scratch.keep(spread_join(v, shared, ["vec"], ["id"]).select(
        "id", F.when(F.col("vec").isNotNull(), F.coalesce("rep", "id")).alias("rep"),
        F.when(F.col("vec").isNotNull(), F.coalesce("weight", F.lit(1))).alias("weight")), "members")
    count = classes.mapInArrow(lambda b: _entries(b, limit, None), "width bigint, block bigint, cell bigint, n bigint")
    crowded = count.groupBy("width", "block", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > TILE)
    # at most one row for each cell of the grids, whose number the geometry bounds
    tiles = {(r.width, r.block, r.cell): -(-r.n // TILE) for r in crowded.collect()}
    entries = classes.mapInArrow(
        lambda b: _entries(b, limit, tiles),
        "width bigint, block bigint, cell bigint, i bigint, j bigint, left boolean, id bigint, vec binary, weight bigint")
    kind = "f4" if v.schema["vec"].dataType.elementType.typeName() == "float" else "f8"
    found = scratch.keep(entries.groupBy("width", "block", "cell", "i", "j").applyInPandas(
        lambda p: _tile(p, limit, cosine, kind), "id bigint, n bigint, root bigint"), "found")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    # repeated ids tie their classes together
    ties = members.where("rep IS NOT NULL AND rep <> id").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    twice = members.where("rep IS NOT NULL").groupBy("id").agg(F.count_distinct("rep").alias("c")).where("c > 1").select(F.col("id").alias("u"))
    comp = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))
                                .unionByName(ties.join(twice, "u", "left_semi")), scratch)
    out = spread_join(members, links.withColumnRenamed("id", "rep").join(
        comp.withColumnRenamed("id", "rep"), "rep", "full_outer"), ["rep"], ["id"])
    one = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce(F.col("n") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).alias("n_links"),
                      one.alias("component_id"), F.coalesce(F.col("id") == one, F.lit(True)).alias("kept"))
