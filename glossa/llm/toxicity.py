"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct words and their beginnings of ``STEMS`` characters
(so that inflected forms share weight), hashed to ``BUCKETS``.  The model has a
weight for every kept term and ``FACTORS`` latent factors whose inner products
are the weights of pairs: an insult next to a mention of a group can count
although neither does alone.

It is fitted on a sample of at most about ``max_per_class`` labelled documents of each
class (chosen by a hash of the id, classes re-weighted to their true sizes);
terms are kept by their log-likelihood ratio with the label, ``TERMS`` at most.
Scoring reads every whole text.

Defined results: a null or empty text has no terms and gets the model's base
rate; without labels of both classes every score is 0; a label joins all
rows that repeat its id; null ids and null labels teach nothing.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, remainder5

BUCKETS, TERMS, FACTORS = 1 << 20, 2048, 8
assert TERMS <= 1 << 16, "a row's columns are held in two bytes each"
STEMS = (4, 5, 6)
#: A term is kept from this log-likelihood ratio on (chance alone passes it less than twice in a thousand).
LEAST_LLR = 10.0
_WORD = re.compile(r"\w+")
_CACHE_LIMIT = 400_000


def term_buckets(word: str) -> tuple[int, ...]:
    stems = [word[:n] + "*" for n in STEMS if len(word) >= n]
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in (word, *stems))


def _hashed(text: str, cache: dict) -> set[int]:
    out: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        t = cache.get(w)
        if t is None:
            if len(cache) > _CACHE_LIMIT:
                cache.clear()
            t = cache[w] = term_buckets(w)
        out.update(t)
    return out


@dataclass
class Model:
    index: dict          # bucket -> column
    bias: float
    weight: np.ndarray   # (n,)
    factor: np.ndarray   # (n, FACTORS)

    def columns(self, text: str | None, cache: dict) -> list[int]:
        """The kept terms of a text; ``cache`` holds them by word."""
        found: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            t = cache.get(w)
            if t is None:
                if len(cache) > _CACHE_LIMIT:
                    cache.clear()
                t = cache[w] = tuple(self.index[b] for b in term_buckets(w) if b in self.index)
            if t:
                found.update(t)
        return sorted(found)

    def score(self, cols: list[int]) -> float:
        v = self.factor[cols]
        s = v.sum(axis=0)
        z = self.bias + self.weight[cols].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def packed(cols: list[int]) -> bytes:
    """The ascending columns of a row, two bytes each: what the driver holds of it.  The bytes sort as the columns do."""
    return np.array(cols, ">u2").tobytes()


def unpacked(row: bytes) -> np.ndarray:
    return np.frombuffer(row, ">u2")


def fit(rows: list, y: np.ndarray, sample_weight: np.ndarray, n: int, epochs: int = 12,
        l2: float = 1e-4, rate: float = 0.02, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic factorization machine by Adam on mini-batches of presence rows."""
    rng = np.random.default_rng(seed)
    base = float(np.clip((y * sample_weight).sum() / sample_weight.sum(), 1e-4, 1 - 1e-4))
    p = {"b": np.array([np.log(base / (1 - base))]), "w": np.zeros(n), "v": rng.normal(0, 0.01, (n, FACTORS))}
    m = {k: np.zeros_like(x) for k, x in p.items()}
    s = {k: np.zeros_like(x) for k, x in p.items()}
    sw = sample_weight / sample_weight.mean()
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 256):
            ids = order[a:a + 256]
            x = np.zeros((len(ids), n))
            for i, r in enumerate(ids):
                x[i, rows[r]] = 1.0
            xv = x @ p["v"]
            z = p["b"] + x @ p["w"] + 0.5 * (xv * xv - x @ (p["v"] ** 2)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[ids]) * sw[ids] / len(ids)
            grad = {"b": np.array([g.sum()]), "w": x.T @ g + l2 * p["w"],
                    "v": x.T @ (g[:, None] * xv) - p["v"] * (x.T @ g)[:, None] + l2 * p["v"]}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
    return float(p["b"][0]), p["w"], p["v"]


def _count(batches):
    """Partial sums of term presence: (bucket, documents, toxic documents)."""
    seen = np.zeros((BUCKETS, 2), np.int32)
    cache: dict = {}
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.fromiter(_hashed(text or "", cache), np.int64)
            seen[ids, y] += 1
    at = np.nonzero(seen.sum(axis=1))[0]
    for a in range(0, len(at), 50_000):
        k = at[a:a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k, 0].astype(np.int64)), pa.array(seen[k, 1].astype(np.int64))],
                                         ["bucket", "neg", "pos"])


def _llr(neg: str, pos: str, n_neg: float, n_pos: float):
    """Log-likelihood ratio of presence and class, as a column."""
    def h(k, n):
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((n - k) / n)).otherwise(0.0)
    a, b = F.col(pos).cast("double"), F.col(neg).cast("double")
    return 2 * (h(a, F.lit(float(n_pos))) + h(b, F.lit(float(n_neg))) - h(a + b, F.lit(float(n_neg + n_pos))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_per_class: int = 12_000) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
             .where((remainder5(F.col("id")) != 0) & F.col("y").isin(0, 1)).distinct())
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model({}, -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    share = {y: min(1.0, max_per_class / n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    # at most about 2 x max_per_class short rows: the texts of the sample are read without a shuffle
    sample = scratch.keep(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
                          .join(F.broadcast(chosen), "id").select("text", "y"), "sample")
    got = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(got) != {0, 1}:
        scratch.clear()
        return Model({}, -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    terms = (sample.mapInArrow(_count, "bucket bigint, neg bigint, pos bigint").groupBy("bucket")
             .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
             .withColumn("llr", _llr("neg", "pos", got[0], got[1])).where(F.col("llr") >= LEAST_LLR)
             .orderBy(F.desc("llr"), "bucket").limit(TERMS))
    index = {r["bucket"]: i for i, r in enumerate(terms.select("bucket").collect())}
    shell = Model(index, 0.0, np.zeros(len(index)), np.zeros((len(index), FACTORS)))

    def columns(batches):
        cache: dict = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([packed(shell.columns(t, cache)) for t in b.column(0).to_pylist()], pa.binary())], ["y", "cols"])

    got = sample.mapInArrow(columns, "y int, cols binary").toArrow()
    rows = sorted(zip(got.column("y").to_pylist(), got.column("cols").to_pylist()))     # the order of a collect isn't fixed
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    b, w, v = fit([unpacked(r[1]) for r in rows], y, weight, len(index))
    scratch.clear()
    return Model(index, b, w, v)


def _score(batches, model: Model, at: int, least: float | None):
    cache: dict = {}
    for b in batches:
        s = np.array([model.score(model.columns(t, cache)) for t in b.column(at).to_pylist()], float)
        if least is None:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])
        else:
            yield b.filter(pa.array(s < least))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    s = d.mapInArrow(lambda b: _score(b, model, 1, None), f"id {d.schema['id'].dataType.simpleString()}, score double")
    return s.select(F.col("id").alias(doc_id), F.coalesce(remainder5(F.col("id")) == 0, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is below ``least``, all columns as they are."""
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda b: _score(b, model, at, least), docs.schema)
