"""Cross-site boilerplate lines.

A line's spread is the number of distinct sites it occurs on.  Every task
folds its lines into one HyperLogLog sketch per line hash, the shuffle merges
the sketches; lines whose estimate is too close to the threshold to decide
get an exact distinct count.  Lines on at least ``min_sites`` sites are
boilerplate and go from every document but the first (smallest id) that holds
them, so that no text is lost altogether.

A line of more than ``long_words`` words is a copied passage as soon as two
documents of different ids hold it, on one site or on several; the smallest and
the largest id of a line tell that exactly.  ``long_words=None`` leaves the
site threshold alone.  Words are runs between white space; a character of a
script without spaces is a word.  Passages are compared as whole lines: one
inside a longer line isn't found.

Lines are compared trimmed of spaces and lower-cased; lines shorter than
``min_chars`` are never boilerplate.  Defined results: a null or empty text has
no lines and stays as it is; a null site isn't counted; a document with a null
id is counted but keeps its lines; repeated rows of one id keep the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, fresh

LG_K = 12
#: Relative standard error of a sketch of 2^12 registers is 1.04 / 64; six of them.
BAND = 0.1
#: Scripts that are written without spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def line_key(line: Column) -> Column:
    norm = F.lower(F.trim(line))
    return F.struct(F.xxhash64(norm).alias("h"), F.length(norm).alias("w"))


def is_long(line: Column, long_words: int | None) -> Column:
    if long_words is None:
        return F.lit(False)
    # so many words take that many characters at least; shorter lines aren't counted
    return (F.length(line) > long_words) & (F.regexp_count(line, F.lit(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")) > long_words)


def _lines(docs: DataFrame, doc_id: str, text: str, site: str, min_chars: int,
           long_words: int | None = None) -> DataFrame:
    return (docs.select(F.col(doc_id).alias("id"), F.col(site).alias("site"),
                        F.explode(F.split(F.col(text), "\n")).alias("line"))
            .select("id", "site", line_key(F.col("line")).alias("key"), is_long(F.col("line"), long_words).alias("long"))
            .where(F.col("key.w") >= min_chars))


def boilerplate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                      min_sites: int = 10, min_chars: int = 20, long_words: int | None = 50) -> DataFrame:
    """(key, first_id) of the lines that occur on ``min_sites`` sites or more, and
    of those of more than ``long_words`` words in two documents or more."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _lines(docs, doc_id, text, site, min_chars, long_words)
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    wide = scratch.keep(
        lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sk"), F.min("id").alias("first_id"),
                                 (F.max("long") & (F.min("id") < F.max("id"))).alias("passage"))
        .select("key", "first_id", F.hll_sketch_estimate("sk").alias("est"), F.coalesce("passage", F.lit(False)).alias("passage"))
        .where((F.col("est") >= low) | F.col("passage")), "wide")
    near = wide.where(~F.col("passage") & (F.col("est") <= high))
    exact = (lines.join(near.select("key"), "key", "left_semi").where(F.col("site").isNotNull())
             .select("key", "site").distinct()
             .groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites))
    return scratch.keep(
        wide.where(F.col("passage") | (F.col("est") > high)).select("key", "first_id")
        .unionByName(near.join(exact.select("key"), "key", "left_semi").select("key", "first_id")), "boilerplate")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = 10, min_chars: int = 20, salts: int = 16, long_words: int | None = 50) -> DataFrame:
    """``docs`` with the text rewritten, and n_lines, n_removed added.

    The lines of a document meet the boilerplate table as (key, id) pairs
    only, on (key, salt); texts are shuffled once, by document.
    """
    found = boilerplate_lines(docs, doc_id, text, site, min_sites, min_chars, long_words)
    salted = (found.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]))))
    lines = (_lines(docs, doc_id, text, site, min_chars).where(F.col("id").isNotNull()).select("id", "key")
             .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")))
    bad_keys, n_lines, n_removed, bad_id = fresh(docs, "bad_keys", "n_lines", "n_removed", "_bad_id")
    bad = (lines.join(salted, ["key", "salt"]).where(F.col("id") != F.col("first_id"))
           .groupBy("id").agg(F.collect_set("key").alias(bad_keys)))
    joined = docs.join(bad.withColumnRenamed("id", bad_id), F.col(doc_id) == F.col(bad_id), "left")
    split = F.split(F.col(text), "\n")
    clean = F.filter(split, lambda x: ~F.array_contains(F.col(bad_keys), line_key(x)))
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    count = F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(breaks + 1)
    new = F.when(F.col(bad_keys).isNull(), F.col(text)).otherwise(F.array_join(clean, "\n"))
    gone = F.when(F.col(bad_keys).isNull(), 0).otherwise(F.size(split) - F.size(clean))
    return joined.select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns],
                         count.cast("long").alias(n_lines), gone.cast("long").alias(n_removed))
