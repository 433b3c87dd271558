"""Edit-aware token counts.

A document is kept as a segment tree: its leaves are stretches of about ``LEAF``
characters that end where a non-space character meets a space or line end, which
is always a border between pre-tokens, so that leaves can be encoded
apart; the nodes hold sums of characters and of tokens.  An edit finds its
leaves by descending the character sums, splices the text there, takes in
neighbours until both borders are safe again, re-encodes only that stretch and
updates the sums on the paths to the root.

The tree of a document is stored as two arrays (characters and tokens of its
leaves), from which the sums are rebuilt.  Tokenizers are read from files, never
trained.

Defined results: a null or empty text has no leaves and no tokens; an edit is
(start, stop, replacement) in characters, clipped to the text; null
replacements delete; edits are applied from the last to the first, and one that
overlaps its successor is cut at the successor's start; null edits do nothing.
A null id is like any other; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 256
# Fixed value: the pre-token pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BORDER = re.compile(r"\S(?=[ \n])")


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """A rank file (about 1 MB, whatever the corpus) from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


@lru_cache(2)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    import tiktoken
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("given", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})


def leaves(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _BORDER.search(text, at + LEAF)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def _safe(left: str, right: str) -> bool:
    return bool(left and right) and not left[-1].isspace() and right[0] in " \n"


class TokenTree:
    """The segment tree of one document."""

    def __init__(self, parts: list[str], tokens: list[int], count):
        self.parts, self.count, self.encoded = parts, count, 0
        self.base = 1 << max(0, len(parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (p, n) in enumerate(zip(parts, tokens)):
            self.chars[self.base + i], self.tokens[self.base + i] = len(p), n
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of a place; the end belongs to the last leaf with text."""
        at = max(0, min(at, self.chars[1] - 1))
        i, first = 1, 0
        while i < self.base:
            i *= 2
            if at - first >= self.chars[i]:
                first += self.chars[i]
                i += 1
        return i - self.base, first

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        i = self.base + leaf
        dc, dt = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        if not self.parts:
            self.parts = [""]
        n = self.chars[1]
        start = max(0, min(start, n))
        stop = max(start, min(stop, n))
        a, first = self._leaf(start) if n else (0, 0)
        b, _ = self._leaf(max(start, stop - 1)) if n else (0, 0)
        old = "".join(self.parts[a:b + 1])
        text = old[:start - first] + new + old[stop - first:]
        while (p := next((i for i in range(a - 1, -1, -1) if self.parts[i]), None)) is not None and not _safe(self.parts[p], text):
            text, a = self.parts[p] + text, p
        while (q := next((i for i in range(b + 1, len(self.parts)) if self.parts[i]), None)) is not None and not _safe(text, self.parts[q]):
            text, b = text + self.parts[q], q
        for i in range(a + 1, b + 1):
            self._set(i, "", 0)
        self._set(a, text, self.count(text))
        self.encoded += len(text)


def ordered(edits: list | None) -> list[tuple[int, int, str]]:
    """From the last to the first, each cut at its successor's start."""
    known = [e for e in edits or () if e is not None and e["start"] is not None and e["stop"] is not None]
    out, top = [], None
    for e in sorted(known, key=lambda e: (e["start"], e["stop"]), reverse=True):
        stop = e["stop"] if top is None else min(e["stop"], top)
        out.append((e["start"], max(e["start"], stop), e["replacement"] or ""))
        top = e["start"]
    return out


def token_trees(docs: DataFrame, ranks: bytes, text: str = "text") -> DataFrame:
    """``docs`` with a column ``tree``: struct(chars, tokens) of arrays over the leaves."""
    docs = docs.drop("tree")        # an input column of that name gives way
    at = docs.columns.index(text)

    def run(batches):
        enc = encoder(ranks)
        kind = pa.list_(pa.int32())
        for b in batches:
            parts = [leaves(t) if t else [] for t in b.column(at).to_pylist()]
            chars = pa.array([[len(x) for x in p] for p in parts], kind)
            tokens = pa.array([[len(enc.encode_ordinary(x)) for x in p] for p in parts], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([chars, tokens], ["chars", "tokens"])],
                                             [*b.schema.names, "tree"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, tree struct<chars: array<int>, tokens: array<int>>")


def apply_edits(trees: DataFrame, ranks: bytes, doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """doc_id, n_chars, n_tokens, n_edits, tokens_after, encoded_chars, new_text, new_tree.

    ``trees`` holds the text, its ``tree`` and the edits: array of struct(start, stop, replacement).
    """
    d = trees.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), "tree", F.col(edits).alias("edits"))
    kind = pa.list_(pa.int32())

    def run(batches):
        enc = encoder(ranks)
        for b in batches:
            out = []
            for t, tree, todo in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                todo = ordered(todo)
                n = sum(tree["tokens"])
                if not todo:
                    out.append((len(t or ""), n, 0, n, 0, t, tree["chars"], tree["tokens"]))
                    continue
                parts, at = [], 0
                for k in tree["chars"]:
                    parts.append(t[at:at + k])
                    at += k
                x = TokenTree(parts, tree["tokens"], lambda s: len(enc.encode_ordinary(s)))
                for e in todo:
                    x.edit(*e)
                kept = [i for i, p in enumerate(x.parts) if p]
                out.append((len(t or ""), n, len(todo), x.total, x.encoded, x.text(), [len(x.parts[i]) for i in kept],
                            [x.tokens[x.base + i] for i in kept]))
            cols = list(zip(*out)) or [[]] * 8
            tree = pa.StructArray.from_arrays([pa.array(cols[6], kind), pa.array(cols[7], kind)], ["chars", "tokens"])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string()), tree],
                                             ["id", "n_chars", "n_tokens", "n_edits", "tokens_after", "encoded_chars", "new_text", "new_tree"])

    out = d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, n_chars bigint, n_tokens bigint, n_edits bigint, "
                            "tokens_after bigint, encoded_chars bigint, new_text string, "
                            "new_tree struct<chars: array<int>, tokens: array<int>>")
    return out.withColumnRenamed("id", doc_id)


def replacements(text: Column, pattern: str, replacement: str) -> Column:
    """The edits that replace every match of a pattern."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    edits = F.transform(hits, lambda x, i: F.struct(
        (length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(hits, F.lit(1), i))).alias("start"), F.length(x).alias("n")))
    edits = F.transform(edits, lambda e: F.struct(e["start"].alias("start"), (e["start"] + e["n"]).alias("stop"),
                                                  F.lit(replacement).alias("replacement")))
    return F.when(text.rlike(pattern), edits)
