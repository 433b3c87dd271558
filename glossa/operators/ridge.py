"""Linear models solved from per-fold Gram matrices.

Training statistics of fold k are ``sum_f G_f - G_k``.  Features are
standardized with the training mean and population sd (as a standard
scaler would), the model is fitted with an intercept, and coefficients
are mapped back to raw units, so scoring is ``b0 + z . b``.  Scoring and
the leave-one-out pass run as ``mapInPandas`` over the design rows with
the small coefficient matrices broadcast.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ridge alpha grid used for leave-one-out selection.
RIDGE_ALPHAS = (1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0,
                1e3, 1e4, 1e5, 1e6, 1e7)


def _centered(G, xi, yi):
    n = G[0, 0]
    m = G[0, :] / n
    cxx = G[np.ix_(xi, xi)] - n * np.outer(m[xi], m[xi])
    cxy = G[xi, yi] - n * m[xi] * m[yi]
    cyy = G[yi, yi] - n * m[yi] ** 2
    return n, m, cxx, cxy, cyy


def ridge_from_gram(G: np.ndarray, xi: list, yi: int, alpha: float, standardize: bool = True) -> np.ndarray:
    """Coefficient vector over all Z columns (index 0 = intercept, unused = 0)."""
    d = G.shape[0]
    beta = np.zeros(d)
    n, m, cxx, cxy, _ = _centered(G, xi, yi)
    if not xi:
        beta[0] = m[yi]
        return beta
    sd = np.sqrt(np.maximum(np.diag(cxx) / n, 0.0)) if standardize else np.ones(len(xi))
    sd[sd == 0] = 1.0
    a = cxx / np.outer(sd, sd)
    b = cxy / sd
    bs = np.linalg.lstsq(a + alpha * np.eye(len(xi)), b, rcond=None)[0]
    braw = bs / sd
    beta[xi] = braw
    beta[0] = m[yi] - m[xi] @ braw
    return beta


def linear_from_gram(G, xi, yi):
    return ridge_from_gram(G, xi, yi, 0.0, standardize=False)


def _score(rows: DataFrame, models: pd.DataFrame, y_index: dict) -> DataFrame:
    """Predictions of every model for the rows of its fold.

    ``models``: columns model_id, fold, outcome, coef (list, length d).
    Output ``(group_id, fold, model_id, y, yhat)``."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(models.to_dict("list"))

    def run(batches):
        m = bc.value
        by_fold = {}
        for mid, f, o, c in zip(m["model_id"], m["fold"], m["outcome"], m["coef"]):
            by_fold.setdefault(f, []).append((mid, o, np.asarray(c)))
        for pdf in batches:
            out = []
            for fold, part in pdf.groupby("fold"):
                if fold not in by_fold:
                    continue
                z = np.vstack(part["z"].to_numpy())
                for mid, o, c in by_fold[fold]:
                    out.append(pd.DataFrame({"group_id": part["group_id"].to_numpy(), "fold": fold,
                                             "model_id": mid, "y": z[:, y_index[o]], "yhat": z @ c}))
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = f"group_id {dict(rows.dtypes)['group_id']}, fold int, model_id string, y double, yhat double"
    return rows.mapInPandas(run, schema)


def ridge_cv_alpha(design, rows: DataFrame, xi: list, outcome: str, alphas=RIDGE_ALPHAS) -> dict:
    """Leave-one-out alpha per fold: ``e_i = (y_i - yhat_i) / (1 - 1/n - h_ii)``
    with h from the eigendecomposition of the standardized training Gram.
    One pass over the rows serves every fold and alpha."""
    yi = design.index(outcome)
    prep = {}
    for k in design.folds:
        G = design.total(exclude=k)
        n, m, cxx, cxy, _ = _centered(G, xi, yi)
        sd = np.sqrt(np.maximum(np.diag(cxx) / n, 0.0))
        sd[sd == 0] = 1.0
        lam, V = np.linalg.eigh(cxx / np.outer(sd, sd))
        c = V.T @ (cxy / sd)
        prep[k] = (n, m[xi], sd, m[yi], lam, V, c)
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(prep)
    al = np.asarray(alphas, float)

    def run(batches):
        pr = bc.value
        acc = {}
        for pdf in batches:
            z = np.vstack(pdf["z"].to_numpy())
            folds = pdf["fold"].to_numpy()
            x, y = z[:, xi], z[:, yi]
            for k, (n, mx, sd, my, lam, V, c) in pr.items():
                sel = folds != k
                if not sel.any():
                    continue
                u = ((x[sel] - mx) / sd) @ V                   # rows x p
                den = lam[None, :] + al[:, None]               # alphas x p
                h = (u * u) @ (1.0 / den).T                     # rows x alphas
                yhat = my + u @ (c[:, None] / den.T)            # rows x alphas
                e = (y[sel][:, None] - yhat) / (1.0 - 1.0 / n - h)
                acc[k] = acc.get(k, 0) + (e * e).sum(axis=0)
        for k, s in acc.items():
            yield pd.DataFrame({"fold": np.full(len(al), k, np.int32), "alpha": al, "sse": s})

    res = rows.mapInPandas(run, "fold int, alpha double, sse double").groupBy("fold", "alpha").agg(
        F.sum("sse").alias("sse")).collect()
    best = {}
    for r in res:
        if r["fold"] not in best or r["sse"] < best[r["fold"]][1] - 1e-12 * abs(best[r["fold"]][1]) or (
                abs(r["sse"] - best[r["fold"]][1]) <= 1e-12 * abs(best[r["fold"]][1]) and r["alpha"] < best[r["fold"]][0]):
            best[r["fold"]] = (r["alpha"], r["sse"])
    return {k: v[0] for k, v in best.items()}


def cv_predict(design, rows: DataFrame, outcomes=None, alpha: float | None = 1000.0, use_feats: bool = True,
               controls=(), model: str = "ridge") -> DataFrame:
    """Out-of-fold predictions ``(group_id, fold, model_id=outcome, y, yhat)``.

    model: ``ridge`` (fixed alpha), ``ridge_cv`` (LOO alpha per fold),
    ``linear`` (least squares, no penalty)."""
    outcomes = list(outcomes or design.outcomes)
    xi = (list(range(1, design.p + 1)) if use_feats else []) + [design.index(c) for c in controls]
    recs = []
    for o in outcomes:
        yi = design.index(o)
        alphas = ridge_cv_alpha(design, rows, xi, o) if model == "ridge_cv" else {}
        for k in design.folds:
            G = design.total(exclude=k)
            if model == "linear":
                c = linear_from_gram(G, xi, yi)
            else:
                c = ridge_from_gram(G, xi, yi, alphas.get(k, alpha) if model == "ridge_cv" else alpha)
            recs.append((o, k, o, c.tolist()))
    models = pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"])
    return _score(rows, models, {o: design.index(o) for o in outcomes})


def control_combos(controls, sizes=None) -> list:
    controls = list(controls)
    sizes = sizes or range(0, len(controls) + 1)
    return [tuple(c) for s in sizes for c in itertools.combinations(controls, s)]


#: Models scored in one pass over the rows.
MODELS_PER_PASS = 2000


def _combo_coef(G: np.ndarray, feats: list, ci: list, yi: int, with_lang: bool, alpha: float, residualized: bool) -> np.ndarray:
    """Coefficients of one model; residualized: language fitted to the residuals of the controls' model."""
    if not (with_lang and residualized and ci):
        return ridge_from_gram(G, ci + (feats if with_lang else []), yi, alpha)
    bc = ridge_from_gram(G, ci, yi, alpha)
    # Gram of (1, X, r) with r = y - [1, C] b
    T = np.eye(G.shape[0])
    T[yi, :] -= bc
    T[yi, yi] = 1.0
    T[yi, 0] = -bc[0]
    c = bc + ridge_from_gram(T @ G @ T.T, feats, yi, alpha)
    c[yi] = 0.0
    return c


def combo_test(design, rows: DataFrame, alpha: float = 1000.0, sizes=None, residualized: bool = False) -> DataFrame:
    """Out-of-fold predictions for every outcome x control combination x
    {controls only, with language}; all models come from the same Grams
    (sub-matrices), are solved in Spark tasks and scored in blocks of models.

    ``residualized``: the language model is fit on the training residuals of
    the controls model (``X'(y - C b) = X'y - X'C b`` from the Gram) and its
    prediction is added to the controls prediction."""
    spark = rows.sparkSession
    feats = list(range(1, design.p + 1))
    place = {o: design.index(o) for o in design.outcomes}
    work = [(f"{o}|{','.join(combo)}|{int(lang)}", k, o, [design.index(c) for c in combo], lang)
            for o in design.outcomes for combo in control_combos(design.controls, sizes)
            for lang in ((False, True) if feats else (False,)) for k in design.folds]
    bc = spark.sparkContext.broadcast({k: design.total(exclude=k) for k in design.folds})      # folds x d x d, d bounded

    def solve(batches):
        grams = bc.value
        for pdf in batches:
            yield pd.DataFrame({"model_id": pdf["model_id"], "fold": pdf["fold"], "outcome": pdf["outcome"], "coef": [
                _combo_coef(grams[r.fold], feats, [int(i) for i in r.controls], place[r.outcome], bool(r.lang), alpha, residualized).tolist()
                for r in pdf.itertuples()]})
    todo = spark.createDataFrame(work, "model_id string, fold int, outcome string, controls array<int>, lang boolean")
    todo = todo.repartition(min(len(work), 4 * spark.sparkContext.defaultParallelism))
    models = todo.mapInPandas(solve, "model_id string, fold int, outcome string, coef array<double>").toPandas()
    out = None
    for i in range(0, len(models), MODELS_PER_PASS):
        part = _score(rows, models.iloc[i:i + MODELS_PER_PASS], place)
        out = part if out is None else out.unionByName(part)
    return out


def score_summary(preds: DataFrame) -> DataFrame:
    """Pooled out-of-fold metrics per model: n, R2, r, MAE, MSE."""
    e = F.col("y") - F.col("yhat")
    a = preds.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum("y").alias("sy"),
        F.sum(F.col("y") ** 2).alias("syy"), F.sum("yhat").alias("sp"), F.sum(F.col("yhat") ** 2).alias("spp"),
        F.sum(F.col("y") * F.col("yhat")).alias("syp"), F.avg(F.abs(e)).alias("mae"))
    n = F.col("n").cast("double")
    sst = F.col("syy") - F.col("sy") ** 2 / n
    r = (n * F.col("syp") - F.col("sy") * F.col("sp")) / F.sqrt(
        (n * F.col("syy") - F.col("sy") ** 2) * (n * F.col("spp") - F.col("sp") ** 2))
    return a.select("model_id", "n", (1 - F.col("sse") / sst).alias("r2"), r.alias("r"), "mae",
                    (F.col("sse") / n).alias("mse"))


def adjust_outcomes(design, rows: DataFrame, outcome: str, alpha: float = 0.0) -> DataFrame:
    """``y - yhat_controls + mean(y)`` with out-of-fold control predictions."""
    p = cv_predict(design, rows, [outcome], alpha=alpha, use_feats=False, controls=design.controls,
                   model="linear" if alpha == 0 else "ridge")
    my = design.total()[0, design.index(outcome)] / design.total()[0, 0]
    return p.select("group_id", "fold", (F.col("y") - F.col("yhat") + F.lit(my)).alias("adjusted"))


def coefficients(design, G: np.ndarray, xi, yi, alpha) -> pd.DataFrame:
    c = ridge_from_gram(G, xi, yi, alpha)
    return pd.DataFrame({"feat": ["_intercept"] + [design.names[i] for i in xi],
                         "weight": [c[0]] + [c[i] for i in xi]})
