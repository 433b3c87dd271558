"""Designs of several named blocks of features, each with its own preparation.

A block (a feature table) has its own scaler, selector and reducer.  All blocks lie in one
sparse design (``sparse.SparseDesign``), a range of columns each, controls last, so
rows are stored once for all of them.  A model is fitted on the training rows:

* every block is standardized with its training mean and sd;
* ``select``: columns whose univariate F test has p < ``select`` / m (family-wise),
  or the ``best`` columns with the largest F, per outcome; a block of which nothing is selected stays whole;
* ``reduce``: the selected columns are replaced by that many principal components;
* the blocks' columns together go into a ridge, which doesn't scale them again; if columns / rows
  is below ``back_off``, into least squares.

Scaler, selector, reducer and model are linear, so the fitted model maps back to a weight for
each original feature (raw units) and an intercept: that is what is saved and applied, by
a join and a sum over the feature tables.  A group without any feature has the
intercept (and its controls).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.dist import betainc
from glossa.operators.lifecycle import feature_order
from glossa.operators.ranks import materialize
from glossa.operators.sparse import (Rows, SparseDesign, column_sd, principal_components, ridge, sparse_design, training_moments)

# Fixed value: share of columns per row below which the simpler model is taken.
BACK_OFF = 0.05


@dataclass(frozen=True)
class Block:
    name: str
    select: float | None = None     # family-wise level
    best: int | None = None         # or number of columns with the largest F
    reduce: int | None = None       # components


@dataclass
class BlockDesign:
    design: SparseDesign
    ranges: dict                    # block -> (first column, end)


def block_design(tables: dict, frame: DataFrame, control_cols=(), outcome_cols=(), value_col: str = "group_norm") -> BlockDesign:
    """``tables``: block -> feature table.  ``frame`` (group_id, fold, controls, outcomes)."""
    frame = frame.na.drop(subset=["group_id", *control_cols])
    order, feats, ranges, at = None, None, {}, 0
    for name, t in tables.items():
        here = t.select("group_id", F.concat(F.lit(name + ":"), "feat").alias("feat"), value_col)
        o = materialize(feature_order(here.join(frame.select("group_id"), "group_id", "left_semi")))
        n = o.count()
        o = o.select("feat", (F.col("idx") + at).cast("int").alias("idx"))
        ranges[name] = (at, at + n)
        at += n
        order = o if order is None else order.unionByName(o)
        feats = here if feats is None else feats.unionByName(here)
    return BlockDesign(sparse_design(feats, frame, control_cols, outcome_cols, value_col, order), ranges)


@dataclass
class BlockModel:
    """Raw weights (columns x outcomes) with what they were made from."""
    outcomes: list
    intercept: np.ndarray
    coef: np.ndarray
    selected: np.ndarray            # columns x outcomes
    model: list                     # per outcome: ridge or linear
    columns: list                   # per outcome: columns that entered the model
    names: DataFrame                # idx, feat (block:feature or control)
    controls: list


def _f_test(n: float, my, myy, mean, second, cross, sd) -> tuple:
    """(F, p) of the univariate regressions."""
    sy = np.sqrt(max(myy - my ** 2, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where((sd > 0) & (sy > 0), ((cross - mean * my) / (sd * sy)) ** 2, 0.0)
        f = r2 / np.maximum(1 - r2, 1e-300) * (n - 2)
    return f, betainc((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + f))


def _picked(block: Block, f: np.ndarray, p: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Columns of a block that its selector takes."""
    at = np.arange(lo, hi)
    if block.select is not None:
        got = at[p[lo:hi] < block.select / max(1, hi - lo)]
    elif block.best is not None:
        got = np.sort(at[np.lexsort((at, -f[lo:hi]))[:block.best]])
    else:
        got = at
    return got if len(got) else at


def _with_scores(design: SparseDesign, reducers: list, drop: np.ndarray) -> SparseDesign:
    """The design with components as further columns, without the columns of ``drop``."""
    bc = design.rows.sparkSession.sparkContext.broadcast(([(c.map, c.mean @ c.map) for c in reducers], drop))
    p, k = design.p, sum(c.vectors.shape[1] for c in reducers)

    def run(batches):
        maps, out = bc.value
        for b in batches:
            if not b.num_rows:
                continue
            r = Rows(b)
            scores = np.concatenate([r.times(m) - s for m, s in maps], axis=1)
            keep = ~out[r.ind]
            count = np.bincount(r.of[keep], minlength=r.n) + k
            off = np.r_[0, np.cumsum(count)].astype(np.int32)
            idx, val = np.empty(off[-1], np.int32), np.empty(off[-1])
            own = np.ones(off[-1], bool)
            tail = (off[1:, None] - k + np.arange(k)).ravel()
            own[tail] = False
            idx[own], val[own] = r.ind[keep], r.val[keep]
            idx[tail], val[tail] = np.tile(np.arange(p, p + k), r.n), scores.ravel()
            yield pa.RecordBatch.from_arrays([b.column("group_id"), b.column("fold"), pa.ListArray.from_arrays(pa.array(off), pa.array(idx)),
                                              pa.ListArray.from_arrays(pa.array(off), pa.array(val)), b.column("y")],
                                             ["group_id", "fold", "idx", "val", "y"])
    rows = materialize(design.rows.mapInArrow(run, design.rows.schema))
    return SparseDesign(rows, design.order, p + k, design.controls, design.outcomes, design.folds, (), design.features)


def fit(blocks: BlockDesign, specs: list, alpha: float = 1000.0, without=None, back_off: float = BACK_OFF) -> BlockModel:
    """A model per outcome on the rows of all folds but ``without``."""
    d = blocks.design
    moments = training_moments(d, [without])
    _, n, my, myy, mean, second, cross = moments
    sd = column_sd(mean, second)
    first_control = d.features
    coef, intercept, chosen, models, widths = np.zeros((d.p, len(d.outcomes))), [], np.zeros((d.p, len(d.outcomes)), bool), [], []
    for o, outcome in enumerate(d.outcomes):
        f, pv = _f_test(n[o], my[o], myy[o], mean[:, o], second[:, o], cross[:, o], sd[:, o])
        inv = np.divide(1.0, sd[:, o], out=np.zeros(d.p), where=sd[:, o] > 0)
        known = d.rows.where(F.col("y")[o].isNotNull() & (F.lit(without is None) | (F.col("fold") != F.lit(without))))
        factor, drop, reducers = np.zeros(d.p), np.zeros(d.p, bool), []
        factor[first_control:], chosen[first_control:, o] = inv[first_control:], True
        for spec in specs:
            lo, hi = blocks.ranges[spec.name]
            got = _picked(spec, f, pv, lo, hi)
            chosen[got, o] = True
            if spec.reduce is None:
                factor[got] = inv[got]
            else:
                here = np.zeros(d.p)
                here[got] = inv[got]
                reducers.append(principal_components(d, min(spec.reduce, len(got)), scale=here, rows=known))
                drop[lo:hi] = True
        one = SparseDesign(d.rows.withColumn("y", F.array(F.col("y")[o])), d.order, d.p, d.controls, [outcome], d.folds, (), d.features)
        if reducers:
            one = _with_scores(one, reducers, drop)
            factor = np.r_[factor, np.ones(one.p - d.p)]
        width = int((factor > 0).sum())
        simple = width / max(n[o], 1) < back_off
        got = ridge(one, [0.0 if simple else alpha], [without], {outcome: factor}, max_steps=5000 if simple else 500)
        w, b0, at = got.coef[:d.p, 0].copy(), got.intercept[0], d.p
        for c in reducers:      # a component's weight, back through reducer, selector and scaler
            gamma = got.coef[at:at + c.vectors.shape[1], 0]
            w += c.map @ gamma
            b0 -= (c.mean @ c.map) @ gamma
            at += c.vectors.shape[1]
        coef[:, o] = w
        intercept.append(float(b0))
        models.append("linear" if simple else "ridge")
        widths.append(width)
    return BlockModel(list(d.outcomes), np.array(intercept), coef, chosen, models, widths, d.names(), list(d.controls))


def weights(model: BlockModel) -> DataFrame:
    """(outcome, feat, weight, selected): features as block:name, controls, ``_intercept``."""
    spark = model.names.sparkSession
    parts = []
    for o, outcome in enumerate(model.outcomes):
        at = np.flatnonzero(model.selected[:, o])
        parts.append(pa.table({"outcome": [outcome] * (len(at) + 1), "idx": pa.array([-1, *at.tolist()], pa.int32()),
                               "weight": np.r_[model.intercept[o], model.coef[at, o]]}))
    w = spark.createDataFrame(pa.concat_tables(parts)).join(model.names, "idx", "left")
    return w.select("outcome", F.coalesce("feat", F.lit("_intercept")).alias("feat"), "weight")


def save(path: str, model: BlockModel) -> None:
    """Weights, and per outcome the model taken, its columns and the controls."""
    weights(model).write.mode("overwrite").parquet(f"{path}/weights")
    rows = [(o, m, c, model.controls) for o, m, c in zip(model.outcomes, model.model, model.columns)]
    model.names.sparkSession.createDataFrame(rows, "outcome string, model string, columns long, controls array<string>").write.mode(
        "overwrite").parquet(f"{path}/models")


def load(spark: SparkSession, path: str) -> tuple:
    """(weights, models) as saved."""
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/models")


def predict(weights_: DataFrame, tables: dict, groups: DataFrame, controls=(), value_col: str = "group_norm") -> DataFrame:
    """(group_id, outcome, yhat) of every group: a join of features and weights, summed."""
    feats = None
    for name, t in tables.items():
        here = t.select("group_id", F.concat(F.lit(name + ":"), "feat").alias("feat"), F.col(value_col).cast("double").alias("v"))
        feats = here if feats is None else feats.unionByName(here)
    for c in controls:
        here = groups.select("group_id", F.lit(c).alias("feat"), F.col(c).cast("double").alias("v"))
        feats = here if feats is None else feats.unionByName(here)
    first = weights_.where("feat = '_intercept'").agg(F.collect_list(F.struct("outcome", F.col("weight").alias("b0")))).first()[0]
    outcomes = F.array(*[F.struct(F.lit(r["outcome"]).alias("outcome"), F.lit(r["b0"]).alias("b0")) for r in first])
    sums = (feats.join(weights_, "feat").groupBy("group_id", "outcome").agg(F.sum(F.col("v") * F.col("weight")).alias("s")))
    all_ = groups.select("group_id", F.explode(outcomes).alias("o")).select("group_id", "o.outcome", "o.b0")
    return all_.join(sums, ["group_id", "outcome"], "left").select("group_id", "outcome", (F.col("b0") + F.coalesce("s", F.lit(0.0))).alias("yhat"))
