"""Tokenizers and n-gram expressions (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our token pattern (letters and digits) and the tweet-aware
# variant that also keeps hashtags, mentions and URLs as single tokens.
WORD_PATTERN = r"[\p{L}\p{N}]+"
TWEET_PATTERN = r"https?://\S+|www\.\S+|[#@][\p{L}\p{N}_]+|[\p{L}\p{N}]+(?:'[\p{L}]+)?"
SENTENCE_END = r"(?<=[.!?])\s+"


def _sql_str(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(col: str = "message", lower: bool = True, pattern: str = WORD_PATTERN) -> Column:
    src = f"lower({col})" if lower else col
    return F.expr(f"regexp_extract_all({src}, {_sql_str('(' + pattern + ')')}, 1)")


def ngrams(tokens_col: str, n: int) -> Column:
    """Array of space-joined n-grams of an array column (empty if too short)."""
    if n == 1:
        return F.col(tokens_col)
    t = tokens_col
    return F.expr(
        f"CASE WHEN size({t}) >= {n} THEN "
        f"transform(sequence(1, size({t}) - {n - 1}), i -> array_join(slice({t}, i, {n}), ' ')) "
        f"ELSE array() END")


def char_ngrams(col: str, n: int) -> Column:
    """Character n-grams of a string column (overlapping, empty if too short)."""
    return F.expr(
        f"CASE WHEN char_length({col}) >= {n} THEN "
        f"transform(sequence(1, char_length({col}) - {n - 1}), i -> substring({col}, i, {n})) "
        f"ELSE array() END")
