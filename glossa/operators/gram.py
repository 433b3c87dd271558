"""Per-fold Gram matrices: the sufficient statistics of every linear model.

``Z = [1, X (vocabulary columns), C (controls), Y (outcomes)]`` per group.
One pass over the groups computes ``G_f = sum_{i in fold f} z_i z_i'`` for
every fold:

* the long feature table is pivoted per group into a dense vocabulary
  array on the JVM (vocabulary size p is bounded, see ``MAX_COLS``);
* ``mapInPandas`` multiplies each task's rows into a partial Gram per fold
  and emits it as upper-triangle tiles ``(fold, ti, tj, bytes)`` (512 x 512);
* tiles are shuffled on their key and summed by a streaming
  ``mapInPandas``; only the ``folds x d x d`` result reaches the driver.

Group rows never leave the executors; the driver solves d x d systems.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranks import global_rank

MAX_COLS = 4000  # above this select features first (select_fwe) or reduce (PCA)


@dataclass
class Design:
    names: list            # column names of Z in order: "1", feats..., controls..., outcomes...
    p: int                 # number of vocabulary columns
    controls: list
    outcomes: list
    grams: dict            # fold -> d x d ndarray

    def index(self, name):
        return self.names.index(name)

    @property
    def folds(self):
        return sorted(self.grams)

    def total(self, exclude=None) -> np.ndarray:
        return sum(g for f, g in self.grams.items() if f != exclude)


def vocabulary(feats: DataFrame, max_cols: int = MAX_COLS) -> DataFrame:
    """``(feat, idx)`` with idx 0..p-1 in feature-name order."""
    v = feats.select("feat").distinct()
    n = v.count()
    if n > max_cols:
        raise ValueError(f"{n} features exceed {max_cols}: use glossa.operators.sparse, or select or reduce first")
    return global_rank(v, [F.col("feat")], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def design_rows(feats: DataFrame | None, vocab: DataFrame | None, frame: DataFrame, control_cols=(),
                outcome_cols=(), value_col: str = "group_norm") -> DataFrame:
    """``(group_id, fold, z array<double>)`` for groups in ``frame``
    (group_id, fold, controls, outcomes); absent features are 0."""
    p = 0 if vocab is None else vocab.count()
    cols = [F.lit(1.0)]
    base = frame
    if feats is not None and p > 0:
        sparse = (feats.join(vocab, "feat").groupBy("group_id")
                  .agg(F.map_from_arrays(F.collect_list("idx"), F.collect_list(F.col(value_col).cast("double"))).alias("_m")))
        base = frame.join(sparse, "group_id", "left")
        dense = F.expr(f"transform(sequence(0, {p - 1}), i -> coalesce(element_at(_m, i), 0D))")
    else:
        dense = F.array().cast("array<double>")
    extra = [F.col(c).cast("double") for c in list(control_cols) + list(outcome_cols)]
    z = F.concat(F.array(F.lit(1.0)), dense, F.array(*extra) if extra else F.array().cast("array<double>"))
    return base.select("group_id", F.col("fold").cast("int").alias("fold"), z.alias("z"))


TILE = 512


def _partial_grams(batches):
    """Per task: partial Gram per fold, emitted as upper-triangle tiles
    ``(fold, ti, tj, bytes)`` of at most TILE x TILE doubles."""
    acc = {}
    for pdf in batches:
        if pdf.empty:
            continue
        for fold, part in pdf.groupby("fold"):
            z = np.vstack(part["z"].to_numpy()).astype(float)
            acc[fold] = acc.get(fold, 0) + z.T @ z
    recs = []
    for fold, g in acc.items():
        nt = (g.shape[0] + TILE - 1) // TILE
        for ti in range(nt):
            for tj in range(ti, nt):
                t = np.ascontiguousarray(g[ti * TILE:(ti + 1) * TILE, tj * TILE:(tj + 1) * TILE])
                recs.append((int(fold), ti, tj, t.shape[0], t.tobytes()))
    if recs:
        yield pd.DataFrame(recs, columns=["fold", "ti", "tj", "rows", "tile"])


def _sum_tiles(batches):
    """Streaming element-wise sum of the tiles of each (fold, ti, tj) key."""
    acc = {}
    for pdf in batches:
        for fold, ti, tj, r, b in zip(pdf["fold"], pdf["ti"], pdf["tj"], pdf["rows"], pdf["tile"]):
            k = (int(fold), int(ti), int(tj), int(r))
            a = np.frombuffer(b, dtype=float)
            acc[k] = acc[k] + a if k in acc else a.copy()
    if acc:
        yield pd.DataFrame([(k[0], k[1], k[2], k[3], v.tobytes()) for k, v in acc.items()],
                           columns=["fold", "ti", "tj", "rows", "tile"])


def fold_grams(rows: DataFrame, d: int, tasks: int | None = None) -> dict:
    """Sum of ``z z'`` per fold.  Partial Grams leave each task as tiles, are
    summed per tile key after a shuffle on the key, and only folds x tiles
    rows reach the driver (through Arrow)."""
    if tasks:
        rows = rows.repartition(tasks)
    schema = "fold int, ti int, tj int, rows int, tile binary"
    part = rows.mapInPandas(_partial_grams, schema)
    summed = part.repartition("fold", "ti", "tj").mapInPandas(_sum_tiles, schema).toPandas()
    grams = {}
    for fold, ti, tj, r, b in summed.itertuples(index=False):
        g = grams.setdefault(int(fold), np.zeros((d, d)))
        t = np.frombuffer(b, dtype=float).reshape(int(r), -1)
        g[ti * TILE:ti * TILE + t.shape[0], tj * TILE:tj * TILE + t.shape[1]] = t
        g[tj * TILE:tj * TILE + t.shape[1], ti * TILE:ti * TILE + t.shape[0]] = t.T
    return grams


def build_design(feats: DataFrame | None, frame: DataFrame, control_cols=(), outcome_cols=(),
                 vocab: DataFrame | None = None, value_col: str = "group_norm") -> tuple:
    """Vocabulary, Design (per-fold Grams) for the groups of ``frame``.

    Rows with a null control or outcome are dropped (one null pattern);
    call once per outcome when outcomes have different null patterns."""
    frame = frame.na.drop(subset=list(control_cols) + list(outcome_cols))
    if feats is not None and vocab is None:
        vocab = vocabulary(feats.join(frame.select("group_id"), "group_id", "left_semi"))
    names = ["1"]
    if vocab is not None:
        names += [r["feat"] for r in vocab.orderBy("idx").collect()]
    p = len(names) - 1
    names += list(control_cols) + list(outcome_cols)
    rows = design_rows(feats, vocab, frame, control_cols, outcome_cols, value_col)
    grams = fold_grams(rows, len(names))
    return vocab, Design(names, p, list(control_cols), list(outcome_cols), grams)
