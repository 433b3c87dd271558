"""Language identification by error-correcting output codes.

Every language has a codeword of +-1 bits; for each bit a binary logistic
classifier over hashed byte n-grams (1 to 4) predicts it from a text.  Decoding
is loss-weighted: a language's cost is the sum over bits of the logistic loss
of the prediction against its bit, weighted by how reliable that bit's
classifier is for that language on the sample.  The cheapest language wins;
``ambiguous`` marks texts whose second-best language is close.

Up to five languages get the exhaustive code, more get the random code with the
largest minimum distance out of several seeded draws, of about 10 log2(n)
bits.  The classifiers are fitted on a sample of at most about
``max_train`` documents, spread evenly over the languages and chosen by a hash of
the text.  Prediction reads every whole text and nothing else.

Defined results: ``und`` with score 0 for a text that is null or has no letter;
without any labelled document everything is ``und``; with one language all
texts with a letter get it with score 1.  Ids play no part; repeated rows are
judged each.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import remainder5

DIM = 1 << 12
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_PIECE = 1 << 20


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams: a vector of length one."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD)
    count = np.zeros(DIM)
    for a in range(0, max(1, len(raw) - 3), _PIECE):        # long texts in pieces that overlap by three bytes
        b = np.frombuffer(raw[a:a + _PIECE + 3], np.uint8).astype(np.uint32)
        last = a + _PIECE + 3 >= len(raw)
        h = np.zeros(len(b), np.uint32)
        for n in range(4):
            h = (h[:len(b) - n] << np.uint32(8)) | b[n:]
            # n-grams that begin in the overlap belong to the next piece
            own = h if last else h[:_PIECE]
            count += np.bincount((own * _MUL[n]) >> np.uint32(32 - 12), minlength=DIM)
            if n < 3:
                h = h[:len(b) - n - 1]
    return np.sqrt(count / count.sum())


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +-1; columns split the languages, no two alike or opposite."""
    if n <= 5:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, float).T.reshape(n, -1)
    bits = max(15, math.ceil(10 * math.log2(n)))
    best, far = None, -1
    for seed in range(50):
        c = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        c = c[:, np.abs(c.sum(axis=0)) < n]
        d = ((c[:, None] != c[None]).sum(axis=2) + np.eye(n) * bits).min()
        if d > far:
            best, far = c, d
    return best


@dataclass
class Model:
    langs: list
    code: np.ndarray      # (languages, bits)
    trust: np.ndarray     # (languages, bits), rows sum to one
    weight: np.ndarray    # (DIM, bits)
    bias: np.ndarray

    def costs(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weight + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        """(languages, scores, margins to the second best)."""
        ok = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        lang, score, margin = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.langs or not ok:
            return lang, score, margin
        for a in range(0, len(ok), 128):
            part = ok[a:a + 128]
            if len(self.langs) == 1:
                p = np.ones((len(part), 1))
            else:
                c = self.costs(np.stack([features(texts[i]) for i in part]))
                p = np.exp(-(c - c.min(axis=1, keepdims=True)) * self.code.shape[1])
                p /= p.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            for i, k, row in zip(part, top, p):
                lang[i], score[i] = self.langs[k], row[k]
                margin[i] = row[k] - np.delete(row, k).max(initial=0.0)
        return lang, score, margin


def fit(x: np.ndarray, y: np.ndarray, langs: list, steps: int = 250, rate: float = 0.5, l2: float = 1e-5) -> Model:
    code = codewords(len(langs))
    target = code[y]                                        # (documents, bits)
    size = np.bincount(y, minlength=len(langs))
    w = (1.0 / size[y])[:, None] / len(langs)
    par = {"w": np.zeros((x.shape[1], code.shape[1])), "b": np.zeros(code.shape[1])}
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in par.items()}
    for t in range(1, steps + 1):
        f = x @ par["w"] + par["b"]
        g = -target * w / (1 + np.exp(np.clip(target * f, -40, 40)))
        for k, grad in (("w", x.T @ g + l2 * par["w"]), ("b", g.sum(axis=0))):
            m, s = mom[k]
            m[:] = 0.9 * m + 0.1 * grad
            s[:] = 0.999 * s + 0.001 * grad ** 2
            par[k] = par[k] - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    right = (x @ par["w"] + par["b"]) * target > 0
    trust = np.stack([(right[y == k].sum(axis=0) + 1) / (size[k] + 2) for k in range(len(langs))])
    return Model(langs, code, trust / trust.sum(axis=1, keepdims=True), par["w"], par["b"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = 3000) -> Model:
    """Fitted on documents with a language and crc32(doc_id) mod 5 other than 0."""
    d = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
         .where((remainder5(F.col("id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # a row per language
    if not sizes:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((DIM, 0)), np.zeros(0))
    langs = sorted(sizes)
    if len(langs) == 1:
        return Model(langs, np.ones((1, 0)), np.ones((1, 0)), np.zeros((DIM, 0)), np.zeros(0))
    each = max(20, max_train // len(langs))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, each / sizes[k]))])
    draw = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) / 1_000_000

    def vectors(batches):
        for b in batches:
            x = [features(t).astype(np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    rows = (d.where(draw < share[F.col("lang")]).select("lang", "text")
            .mapInArrow(vectors, "lang string, x binary").collect())
    rows.sort(key=lambda r: (r["lang"], r["x"]))   # the order of a collect isn't fixed
    at = {k: i for i, k in enumerate(langs)}
    kept = sorted({r["lang"] for r in rows})
    if len(kept) < 2:
        return Model(kept, np.ones((len(kept), 0)), np.ones((len(kept), 0)), np.zeros((DIM, 0)), np.zeros(0))
    at = {k: i for i, k in enumerate(kept)}
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), DIM).astype(float)
    return fit(x, np.array([at[r["lang"]] for r in rows]), kept)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", close: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            lang, score, margin = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(margin < close)], ["id", "lang_pred", "score", "ambiguous"])

    out = d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(doc_id), F.coalesce(remainder5(F.col("id")) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "ambiguous")
