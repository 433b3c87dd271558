"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared after folding: lower-cased, every run of ASCII
characters that are no letters or digits becomes one space.  A benchmark item
is cut into segments of ``SEG`` folded bytes, ``STEP`` apart (a shorter item is
one segment); a document is contaminated by an item when one of its segments
occurs in it with at most ``RATE`` x length edits.

A verbatim quote from anywhere in a longer item holds a whole segment, and is
always found, from ``SEG + STEP - 1`` = 111 folded bytes (some 17 words) on; from
``SEG`` bytes on that depends on where it begins, and shorter parts of a longer
item are not found.

1. Every segment is indexed by its disjoint q-grams.  An edit spoils at most
   one of them, so an occurrence with e edits shares at least n - e, and all
   lie in diagonals (document minus segment position) that differ by e at
   most: in one of the overlapping bands of 2 (e + 1) diagonals.
2. In a band that passes, all q-grams of the segment are counted: at least
   length - q + 1 - q e of them must match inside the band (q-gram lemma).
3. What is left is aligned within the band; the edit distance decides.

The benchmark is taken in blocks of at most about ``BLOCK_SEGMENTS`` segments (some
MB); each block's index goes to the tasks that scan the documents.  Whole texts
are scanned.  Defined results: null or empty texts match nothing; items of
fewer than ``Q`` folded bytes are no evidence and match nothing; equal items are
reported each; a null id is reported as null; repeated rows of one id are
reported as one document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch

Q, SEG, STEP, RATE = 10, 96, 16, 0.08
BLOCK_SEGMENTS = 50_000
_FOLD = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_P, _P2, _P4 = (np.array(pow(0x9E3779B97F4A7C15, k, 1 << 64), np.uint64) for k in (1, 2, 4))


def fold(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes, place of each in the text)."""
    b = np.frombuffer(text.translate(_FOLD), np.uint8)
    keep = b != 32
    keep[1:] |= b[:-1] != 32
    at = np.nonzero(keep)[0]
    return b[at], at


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """The hash of the Q bytes from each place on (Q = 8 + 2)."""
    if len(b) < Q:
        return np.empty(0, np.uint64)
    h = b.astype(np.uint64)
    two = h[:-1] * _P + h[1:]
    four = two[:-2] * _P2 + two[2:]
    eight = four[:-4] * _P4 + four[4:]
    return eight[:-2] * _P2 + two[8:]


def segments(text: bytes) -> list[tuple[int, bytes]]:
    b = fold(text.strip())[0].tobytes().strip()
    starts = list(range(0, max(1, len(b) - SEG + 1), STEP))
    if len(b) > SEG and starts[-1] + SEG < len(b):
        starts.append(len(b) - SEG)
    return [(s, b[s:s + SEG]) for s in starts if len(b) >= Q]


def budget(length: int) -> int:
    """Edits that an occurrence of a segment may have; below its number of disjoint q-grams."""
    return min(int(RATE * length), length // Q - 1)


def banded_distance(seg: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Fewest edits between the segment and any stretch of the text whose
    alignment keeps to diagonals low..high, with its first place and end;
    edits above ``most`` are given as most + 1."""
    w, n = high - low + 1, len(text)
    far = np.int32(1 << 20)
    cols = np.arange(w)
    place = cols + low                                  # text places before row 0
    cost = np.where((place >= 0) & (place <= n), 0, far).astype(np.int32)
    start = place.copy()
    for i, c in enumerate(seg):
        place = cols + low + i                           # the place that a match consumes
        inside = (place >= 0) & (place < n)
        diag = np.where(inside, cost + (text[np.clip(place, 0, n - 1)] != c), far)
        up = np.append(cost[1:], far) + 1                # the segment's byte is missing in the text
        new = np.where(diag <= up, diag, up)
        src = np.where(diag <= up, start, np.append(start[1:], 0))
        ok = (place + 1 >= 0) & (place + 1 <= n)
        new = np.where(ok, new, far)
        run = np.minimum.accumulate(new - cols)          # extra bytes in the text
        back = run + cols
        best = np.where(new - cols == run, cols, 0)
        best = np.maximum.accumulate(best)
        start = src[best]
        cost = np.where(ok, back, far).astype(np.int32)
        if cost.min() > most:
            return most + 1, 0, 0
    k = int(cost.argmin())
    return int(min(cost[k], most + 1)), int(start[k]), int(k + low + len(seg))


@dataclass
class Index:
    """The disjoint q-grams of a block's segments."""

    items: list
    segs: list[np.ndarray]
    keys: np.ndarray       # sorted hashes of all postings
    seg: np.ndarray        # segment and place of each posting
    place: np.ndarray
    door: np.ndarray       # bitmap over the hashes' upper bits
    edits: np.ndarray      # of each segment: its edit budget, and the q-grams that must be shared
    need: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]]) -> Index:
        segs = [np.frombuffer(s, np.uint8) for _, s in rows]
        grams = [gram_hashes(s)[::Q][: len(s) // Q] for s in segs]
        seg = np.repeat(np.arange(len(segs)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) * Q for g in grams]) if grams else np.empty(0, int)
        keys = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        o = np.argsort(keys, kind="stable")
        bits = max(16, int(len(keys) * 32).bit_length())
        door = np.zeros(1 << bits, bool)
        door[keys >> np.uint64(64 - bits)] = True
        lens = np.array([len(s) for s in segs], int)
        edits = np.minimum((RATE * lens).astype(int), lens // Q - 1)
        return cls([i for i, _ in rows], segs, keys[o], seg[o], place[o], door, edits, lens // Q - edits)

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(segment, edits, first byte, end byte in the text) of the occurrences, the best for each segment."""
        b, at = fold(text)
        h = gram_hashes(b)
        pos = np.nonzero(self.door[h >> np.uint64(65 - len(self.door).bit_length())])[0]
        if not len(pos):
            return []
        lo, hi = np.searchsorted(self.keys, h[pos], "left"), np.searchsorted(self.keys, h[pos], "right")
        n = hi - lo
        if not n.sum():
            return []
        pos = np.repeat(pos, n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        enough = np.bincount(self.seg[post], minlength=len(self.segs)) >= self.need
        on = enough[self.seg[post]]
        if not on.any():
            return []
        pos, post = pos[on], post[on]
        seg, place = self.seg[post], self.place[post]
        diag = pos - place
        band = diag // (self.edits[seg] + 1)
        # a hit counts for the band that begins here and for the one before; a q-gram counts once
        key = np.unique(np.stack([np.tile(seg, 2), np.concatenate([band, band - 1]), np.tile(place, 2)], 1), axis=0)
        pair, count = np.unique(key[:, :2], axis=0, return_counts=True)
        out: dict[int, tuple[int, int, int, int]] = {}
        for (s, k), c in zip(pair.tolist(), count.tolist()):
            if c < self.need[s] or (s in out and out[s][1] == 0):
                continue
            word, e = self.segs[s], int(self.edits[s])
            low, high = k * (e + 1), (k + 2) * (e + 1) - 1
            shared, exact = self._shared(word, h, low, high)
            if shared < len(word) - Q + 1 - Q * e:
                continue
            if exact is not None:
                d, x, y = 0, exact, exact + len(word)
            else:
                a, z = max(0, low), min(len(b), high + len(word) + 1)
                d, x, y = banded_distance(word, b[a:z], low - a, high - a, e)
                x, y = max(0, x + a), min(len(b), y + a)
            if d <= e and (s not in out or d < out[s][1]):
                out[s] = (s, d, int(at[min(x, len(at) - 1)]), int(at[max(0, y - 1)]) + 1)
        return list(out.values())

    @staticmethod
    def _shared(word, h, low, high) -> tuple[int, int | None]:
        """Number of places of the segment whose q-gram matches the text inside the
        band, and the text's place when all of them do on one diagonal."""
        own = gram_hashes(word)
        hit = np.zeros(len(own), bool)
        for i in range(low, high + 1):
            a, z = max(0, -i), min(len(own), len(h) - i)
            if z > a:
                same = own[a:z] == h[a + i:z + i]
                if z - a == len(own) and same.all():
                    return len(own), i
                hit[a:z] |= same
        return int(hit.sum()), None


def _scan(batches, index: Index):
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text and text.lower().encode()
            for s, d, x, y in index.find(text) if text else ():
                # places as characters of the lower-cased text
                out.append((doc, index.items[s], s, d, len(text[:x].decode(errors="ignore")), len(text[:y].decode(errors="ignore"))))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
            ["doc_id", "item_id", "segment", "edits", "first", "last"])


def _cut(batches):
    for b in batches:
        rows = [(i, s, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for s, w in (segments(t.lower().encode()) if t else ())]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.binary())], ["item", "place", "seg"])


def index_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The benchmark's segments as indexes of bounded size, one after the other."""
    scratch = Scratch(benchmark.sparkSession, "benchmark")
    segs = scratch.keep(benchmark.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(
        _cut, "item bigint, place bigint, seg binary"), "segments")
    n = -(-segs.count() // BLOCK_SEGMENTS)
    for k in range(n):
        part = segs.where(F.pmod(F.xxhash64("item", "place"), F.lit(n)) == k).collect()
        yield Index.of([(r["item"], bytes(r["seg"])) for r in sorted(part, key=lambda r: (r["item"] is None, r["item"], r["place"]))])
    scratch.clear()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_segments, edits, first, last): a row for each document
    and item found in it; edits of its best segment, the stretch in characters."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id bigint, segment bigint, edits bigint, first bigint, last bigint"
    found = None
    for index in index_blocks(benchmark):
        one = d.mapInArrow(lambda b, i=index: _scan(b, i), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_segments"), F.min("edits").alias("edits"), F.min("first").alias("first"), F.max("last").alias("last"))


def _drop(batches, index: Index, at: int):
    for b in batches:
        clean = [not (t and index.find(t.lower().encode())) for t in b.column(at).to_pylist()]
        yield b.filter(pa.array(clean, pa.bool_()))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without contamination, all columns as they are."""
    at = docs.columns.index(text)
    for index in index_blocks(benchmark):
        docs = docs.mapInArrow(lambda b, i=index: _drop(b, i, at), docs.schema)
    return docs
