"""Periodic runs of words, found in tiles by period octave and stitched by period.

A document's words are numbered from 0.  The periods fall into octaves (1 to 15,
16 to 31, 32 to 63 ...); an octave whose periods are all below D (16, 32, 64 ...)
has a boundary at every D-th word.  A run of period q and a length of at least
max(24, 3 q) has at least max(16, 2 q) places i where word i equals word i + q, so
one of its octave's boundaries lies among them.  The tile of a boundary b holds
the words from b - D to b + 2 D; a Z-function of its right part gives how far the
words after b repeat at every distance, and one of its reversed left part how far
those before b do, D places either way at most.  A tile is solved alone; what it
finds is an interval of such places for a period (a fragment).

Documents are taken apart into tiles and the tiles solved where the text is read;
fragments of neighbouring tiles that touch are joined there (a combiner).  The
fragments are then shuffled by document and period and stitched where they touch.  A
period whose first q words at b are a power of fewer words is left out in the
tile: by the periodicity lemma a run of length 3 q has a smaller period just then.

A tile without an eight-word sequence at b (or ending at b) that returns at one
of its octave's distances can hold no run and is passed over; this drops nothing, as
the longer side of a boundary inside a run has eight places or more.

Words are runs of characters other than space, tab, line feed, vertical tab, form
feed and carriage return.  Defined results: null, empty and blank texts have no
words and no runs; texts of any length are taken whole (memory grows with the
text of a row, tiles of one text are solved one after the other); rows that
repeat an id or have a null id are documents of their own; an empty table stays
empty.  Columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch

LEAST, FOLD = 24, 3     # a run's least length in words and in periods
PROBE = 8               # words of the sequence that a tile is probed with
BASE = 16               # distance of the first octave's boundaries

_FRAGMENT = "struct<period:int,a:int,e:int>"


def word_list(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []    # bytes: ASCII white space only


def periodic_tail(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a document whose id's checksum asks for a repeated tail; others unchanged."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from 0 on; z[0] is the length."""
    n = len(s)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@functools.lru_cache(1 << 16)
def _prime_divisors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


def solve_tile(w: np.ndarray, b: int, low: int, d: int, among: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Fragments (period, first, end) at boundary ``b`` for the periods from ``low`` to
    ``d`` - 1 (or those ``among`` them), places from b - d to b + d."""
    n = len(w)
    zr = z_function(w[b:b + 2 * d].tolist())
    end = min(n, b + d)
    left = w[max(0, b - d):b][::-1].tolist()
    zl = z_function(left + [-1] + w[max(0, b - d):end][::-1].tolist())[len(left) + 1:]
    out = []
    for q in (range(low, d) if among is None else among.tolist()):
        if b + q > n:
            break
        f = min(zr[q], d) if b + q < n else 0
        at = end - b - q
        g = min(zl[at], d) if at >= 0 and left else 0
        if f < d and g < d and f + g + q < max(LEAST, FOLD * q):
            continue    # the whole stretch, and too short
        if any(zr[q // r] >= q - q // r for r in _prime_divisors(q)):
            continue    # a power of fewer words
        out.append((q, b - g, b + f))
    return out


def fragments(w: np.ndarray) -> list[tuple[int, int, int]]:
    """The fragments of all tiles of a document; touching ones of neighbouring tiles joined."""
    n = len(w)
    if n < LEAST:
        return []
    h = np.zeros(n - PROBE + 1, np.uint64)
    for i in range(PROBE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (w[i:n - PROBE + 1 + i].astype(np.uint64) + np.uint64(1))
        h ^= h >> np.uint64(29)
    if len(set(h.tolist())) == len(h):
        return []       # no eight words return anywhere
    out, low, d = [], 1, BASE
    while low <= n // FOLD:
        open_: dict[int, list[int]] = {}
        for b in range(0, n - low + 1, d):
            near = np.zeros(d - low, bool)
            for at in (b, b - PROBE):
                if 0 <= at < len(h):
                    there = h[at + low:at + d] == h[at]
                    near[:len(there)] |= there
            if not near.any():
                continue
            for q, a, e in solve_tile(w, b, low, d, low + np.flatnonzero(near)):
                x = open_.get(q)
                if x and a <= x[1]:
                    x[1] = max(x[1], e)
                else:
                    if x:
                        out.append((q, *x))
                    open_[q] = [a, e]
        out += [(q, *x) for q, x in open_.items()]
        low, d = d, 2 * d
    return out


def _solved(batches, change):
    for batch in batches:
        ids, texts = batch.column(1), batch.column(2)
        n, plain, found = [], [], []
        for i, t in zip(ids.to_pylist(), texts.to_pylist()):
            words = change(word_list(t), i)
            seen: dict[bytes, int] = {}
            got = fragments(np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words)))
            n.append(len(words))
            plain.append(None if got else hashlib.sha256(b" ".join(words)).hexdigest())
            found.append([{"period": q, "a": a, "e": e} for q, a, e in got])
        has = pa.array([p is None for p in plain])
        kept = pc.if_else(has, texts, pa.scalar(None, texts.type))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), ids, kept, pa.array(n, pa.int64()), pa.array(plain, pa.string()),
             pa.array(found, pa.list_(pa.struct([("period", pa.int32()), ("a", pa.int32()), ("e", pa.int32())])))],
            ["row", "id", "text", "n", "plain", "found"])


def stitch(frag: DataFrame) -> DataFrame:
    """(row, period, a, e) fragments -> (row, start, length, period) runs: intervals of a
    document and period that touch are one."""
    by = Window.partitionBy("row", "period").orderBy("a", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0)
    runs = (frag.withColumn("first", first).withColumn("run", F.sum("first").over(by))
            .groupBy("row", "period", "run").agg(F.min("a").alias("start"), F.max("e").alias("e")))
    length = F.col("e") - F.col("start") + F.col("period")
    return (runs.select("row", F.col("start").cast("long"), length.cast("long").alias("length"), F.col("period").cast("long"))
            .where(f"length >= greatest({LEAST}, {FOLD} * period)"))


def _collapsed(batches, change):
    for batch in batches:
        out = []
        for i, t, runs in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            words = change(word_list(t), i)
            keep = np.ones(len(words), bool)
            best, seen = None, hashlib.sha256()
            for r in sorted(runs or [], key=lambda r: (r["start"], r["period"])):
                s, m, q = r["start"], r["length"], r["period"]
                keep[s + q:s + m] = False
                seen.update(f"{s},{m},{q}\n".encode())
                if best is None or m * best[2] > best[1] * q:
                    best = (s, m, q)
            s, m, q = best or (None, None, None)
            left = b" ".join(words[k] for k in np.flatnonzero(keep).tolist())
            out.append((s, m, q, 1000 * m // q if best else None, seen.hexdigest(),
                        hashlib.sha256(left).hexdigest(), left.decode()))
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        cols = zip(*out) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                         ["row", "start", "length", "period", "exponent_milli", "runs_sha256",
                                          "collapsed_sha256", "collapsed"])


def _plain_words(words, _):
    return words


def runs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            change: Callable = _plain_words) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): a row per row of ``docs`` (row, id, n, plain, text), text only where
    there are fragments and plain the digest of the words elsewhere; and the runs (row, start,
    length, period).  ``change(words, id)`` may rewrite the words first."""
    scratch = Scratch(docs.sparkSession, "periodic")
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"row long, id {docs.schema[doc_id].dataType.simpleString()}, text string, n long, plain string, found array<{_FRAGMENT}>"
    solved = scratch.keep(d.mapInArrow(lambda b: _solved(b, change), schema), "solved")
    runs = stitch(solved.where("plain IS NULL").select("row", F.explode("found").alias("f")).select("row", "f.*"))
    return solved.drop("found"), runs


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Callable = _plain_words) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_runs; start, length, period and
    exponent_milli of the run with the greatest length / period (ties: smallest start, then
    period); runs_sha256; collapsed_sha256 and, where there are runs, the collapsed text (every
    run cut to its first period)."""
    solved, runs = runs_of(docs, doc_id, text, change)
    lists = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    some = solved.where("plain IS NULL").join(lists, "row", "left").select("row", "id", "text", "runs", "n")
    schema = "row long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    named = F.struct("n", F.coalesce(F.array_size("runs"), F.lit(0)).alias("n_runs"))
    kind = docs.schema[doc_id].dataType.simpleString()
    done = some.select("row", "id", "text", "runs", named.alias("more")).mapInArrow(
        lambda b: _with_id(b, change), f"id {kind}, n long, n_runs long, " + schema)
    none = hashlib.sha256(b"").hexdigest()
    rest = solved.where("plain IS NOT NULL").select(
        "id", "n", F.lit(0).cast("long").alias("n_runs"), *[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(none).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"), F.lit(None).cast("string").alias("collapsed"))
    return done.drop("row").unionByName(rest).withColumnRenamed("id", doc_id).withColumnRenamed("n", "n_words")


def _with_id(batches, change):
    for batch in batches:
        more = batch.column(4)
        for out in _collapsed([batch], change):
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), more.field("n"), more.field("n_runs").cast(pa.int64()), *out.columns],
                ["id", "n", "n_runs", *out.schema.names])
