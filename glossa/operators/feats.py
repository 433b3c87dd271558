"""Messages -> long feature tables ``(group_id, feat, value, group_norm)``.

All extractors explode tokens on the map side and aggregate with partial
(map-side) aggregation on ``(group_id, feat)``.  The per-group total used
for ``group_norm`` is a second aggregate of the same counts joined back on
``group_id`` (a join, not a window, so AQE can split a hot group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import WORD_PATTERN, char_ngrams, ngrams, tokens
from glossa.functions.values import value_func
from glossa.operators.ranks import materialize

_FEAT_COLS = ["group_id", "feat", "value", "group_norm"]


def attach_group_norm(counts: DataFrame, vfunc: str | None = None, kept: bool = False) -> DataFrame:
    """``group_norm = vfunc(value / sum(value) over the group)``.  Of a stored table (``kept``) the totals are
    written first, so that those of few groups are sent to the rows instead of the rows to them."""
    totals = counts.groupBy("group_id").agg(F.sum("value").alias("_total"))
    if kept:
        totals = materialize(totals)
    norm = F.col("value") / F.nullif(F.col("_total"), F.lit(0.0))
    return (counts.join(totals, "group_id")
            .select("group_id", "feat", F.col("value").cast("double").alias("value"),
                    value_func(vfunc, norm).cast("double").alias("group_norm")))


def apply_value_func(feats: DataFrame, vfunc: str, lexicon: bool = False) -> DataFrame:
    return feats.withColumn("group_norm", value_func(vfunc, F.col("group_norm"), lexicon))


def ngram_counts(messages: DataFrame, n: int = 1, lower: bool = True,
                 pattern: str = WORD_PATTERN) -> DataFrame:
    toks = messages.select("group_id", tokens("message", lower, pattern).alias("_t"))
    grams = toks.select("group_id", F.explode(ngrams("_t", n)).alias("feat"))
    return grams.groupBy("group_id", "feat").agg(F.count(F.lit(1)).cast("double").alias("value"))


def ngram_feats(messages: DataFrame, n=1, lower: bool = True, vfunc: str | None = None) -> DataFrame:
    """n-gram features; ``n`` may be a list (one table per n, unioned)."""
    ns = [n] if isinstance(n, int) else list(n)
    out = None
    for k in ns:
        t = attach_group_norm(ngram_counts(messages, k, lower), vfunc)
        out = t if out is None else out.unionByName(t)
    return out


def lone_message_feats(messages: DataFrame, n: int = 1, lower: bool = True, vfunc: str | None = None) -> DataFrame:
    """``ngram_feats`` of messages most of which are their group's only one (documents): such a row is counted by
    itself, its n-grams in order, and no n-gram of it is shuffled.  Groups of several messages, and rows without a
    group, are counted together as ever."""
    several = materialize(messages.groupBy("group_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("group_id"))
    rest = messages.join(several, "group_id", "left_anti").where(F.col("group_id").isNotNull())
    toks = rest.select("group_id", tokens("message", lower, WORD_PATTERN).alias("_t"))
    # a filter on these arrays would be moved before the steps that make them, and make them again
    grams = toks.select("group_id", F.sort_array(ngrams("_t", n)).alias("_s"))
    starts = grams.select("group_id", "_s", F.expr("filter(CASE WHEN size(_s) > 0 THEN sequence(1, size(_s)) END, i -> i = 1 OR _s[i - 1] <> _s[i - 2])").alias("_i"))
    each = starts.select("group_id", F.explode(F.expr(
        "transform(_i, (i, k) -> struct(_s[i - 1] AS feat, CAST(coalesce(get(_i, k + 1), size(_s) + 1) - i AS DOUBLE) AS value, CAST(size(_s) AS DOUBLE) AS total))")).alias("_f"))
    norm = F.col("_f.value") / F.col("_f.total")
    own = each.select("group_id", "_f.feat", "_f.value", value_func(vfunc, norm).cast("double").alias("group_norm"))
    if several.isEmpty():
        return own
    return own.unionByName(ngram_feats(messages.join(several, "group_id", "left_semi"), n, lower, vfunc))


def ngrams_from_tokenized(tokenized: DataFrame, n: int = 1, vfunc: str | None = None) -> DataFrame:
    """n-grams from ``(group_id, tokens_json)`` where tokens_json is a JSON list."""
    t = tokenized.select("group_id", F.from_json("tokens_json", "array<string>").alias("_t"))
    grams = t.select("group_id", F.explode(ngrams("_t", n)).alias("feat"))
    counts = grams.groupBy("group_id", "feat").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return attach_group_norm(counts, vfunc)


def char_ngram_feats(messages: DataFrame, n: int = 3, vfunc: str | None = None) -> DataFrame:
    """Character n-grams inside each lower-cased token."""
    toks = messages.select("group_id", F.explode(tokens("message")).alias("_w"))
    grams = toks.select("group_id", F.explode(char_ngrams("_w", n)).alias("feat"))
    counts = grams.groupBy("group_id", "feat").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return attach_group_norm(counts, vfunc)


def meta_feats(messages: DataFrame) -> DataFrame:
    """Per-group message statistics as features (value = group_norm)."""
    per_msg = messages.select(
        "group_id", F.size(tokens("message", lower=False)).alias("n_tok"),
        F.char_length("message").alias("n_chr"))
    agg = per_msg.groupBy("group_id").agg(
        F.count(F.lit(1)).cast("double").alias("_n_msgs"),
        F.sum("n_tok").cast("double").alias("_total_tokens"),
        F.avg("n_tok").alias("_avg_tokens_per_msg"),
        F.avg("n_chr").alias("_avg_chars_per_msg"))
    names = ["_n_msgs", "_total_tokens", "_avg_tokens_per_msg", "_avg_chars_per_msg"]
    stack = "stack(4, " + ", ".join(f"'{c}', {c}" for c in names) + ") as (feat, value)"
    return agg.select("group_id", F.expr(stack)).select(
        "group_id", "feat", "value", F.col("value").alias("group_norm"))


def lexicon_feats(word_feats: DataFrame, lexicon: DataFrame, weighted: bool = False,
                  vfunc: str | None = None) -> DataFrame:
    """Lexicon categories from 1-gram features.

    plain: value = sum(value), group_norm = sum(group_norm) over the category's terms;
    weighted: both sums weighted by the term weight, and the category's
    ``_intercept`` weight (if any) is added to group_norm.  ``word_feats``
    must carry relative frequencies (identity value function).
    """
    lex = lexicon.select(F.col("category").alias("_cat"), F.col("term").alias("feat"),
                         F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight"))
    terms = lex.where(F.col("feat") != "_intercept")
    j = word_feats.join(terms, "feat")
    w = F.col("weight") if weighted else F.lit(1.0)
    # Exact weighted sums (decimal products), then one division by the group
    # total: sum(group_norm * w) == sum(value * w) / total, but independent of
    # the summation order, so results are reproducible bit for bit.
    dec = F.col("value").cast("decimal(20,6)") * w.cast("decimal(12,6)")
    totals = word_feats.groupBy("group_id").agg(F.sum("value").alias("_tot"))
    agg = (j.groupBy("group_id", F.col("_cat").alias("feat")).agg(F.sum(dec).cast("double").alias("value"))
           .join(totals, "group_id")
           .withColumn("group_norm", F.col("value") / F.col("_tot")).drop("_tot"))
    if weighted:
        icpt = lex.where(F.col("feat") == "_intercept").select(
            F.col("_cat").alias("feat"), F.col("weight").alias("_icpt"))
        agg = (agg.join(icpt, "feat", "left")
               .withColumn("group_norm", F.col("group_norm") + F.coalesce("_icpt", F.lit(0.0)))
               .drop("_icpt"))
    out = agg.select(*_FEAT_COLS)
    return apply_value_func(out, vfunc, lexicon=True) if vfunc else out


def topic_states(messages: DataFrame, n_topics: int = 8) -> DataFrame:
    """Topic-state rows ``(message_id, group_id, pos, token, topic)``.

    The topic assignment is a pure function of the token
    (``char_length(token) % n_topics``) standing in for a sampler state file.
    """
    t = messages.select("message_id", "group_id", F.posexplode(tokens("message")).alias("pos", "token"))
    return t.withColumn("topic", (F.char_length("token") % n_topics).cast("int"))


def topic_feats(states: DataFrame, vfunc: str | None = None) -> DataFrame:
    """Topic shares per group from ``(group_id, topic)`` state rows."""
    counts = (states.groupBy("group_id", F.col("topic").cast("string").alias("feat"))
              .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return attach_group_norm(counts, vfunc)


def topic_lexicon(states: DataFrame, method: str = "standard") -> DataFrame:
    """Topic lexicon ``(category=topic, term=word, weight)`` from state counts.

    standard: p(topic | word); csv_lik: p(word | topic).
    """
    c = states.groupBy(F.col("topic").cast("string").alias("category"),
                       F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("c"))
    key = "term" if method == "standard" else "category"
    tot = c.groupBy(key).agg(F.sum("c").alias("_tot"))
    return (c.join(tot, key)
            .select("category", "term", (F.col("c") / F.col("_tot")).alias("weight")))


# Syllables are runs of these vowels (min. one per word).
VOWELS = "aeiouyàáâäèéêëìíîïòóôöùúûü"


def flesch_kincaid(messages: DataFrame) -> DataFrame:
    """Flesch-Kincaid grade level, mean over the group's messages.

    ``0.39 * words/sentences + 11.8 * syllables/words - 15.59``; sentences are
    runs of ``.!?`` (at least one), syllables are vowel runs (at least one per word).
    """
    m = messages.select("group_id", tokens("message").alias("_t"),
                        F.greatest(F.lit(1), F.size(F.expr(r"regexp_extract_all(message, '([.!?]+)', 1)")))
                        .alias("_s"))
    syl = F.expr(f"aggregate(transform(_t, w -> greatest(1, size(regexp_extract_all(w, '([{VOWELS}]+)', 1)))),"
                 " 0, (a, b) -> a + b)")
    m = m.where(F.size("_t") > 0).select(
        "group_id", (F.lit(0.39) * F.size("_t") / F.col("_s") + F.lit(11.8) * syl / F.size("_t")
                     - F.lit(15.59)).alias("fk"))
    agg = m.groupBy("group_id").agg(F.avg("fk").alias("value"))
    return agg.select("group_id", F.lit("flesch_kincaid").alias("feat"), "value",
                      F.col("value").alias("group_norm"))


def tf_idf(feats: DataFrame) -> DataFrame:
    """``group_norm * ln(N / df)``, N = groups in the table, df = groups with the feature."""
    n_groups = feats.select("group_id").distinct().count()
    df = feats.groupBy("feat").agg(F.count(F.lit(1)).alias("_df"))
    return (feats.join(df, "feat")
            .select("group_id", "feat", "value",
                    (F.col("group_norm") * F.log(F.lit(float(n_groups)) / F.col("_df"))).alias("group_norm")))


def colloc_feats(word_counts: DataFrame, ngram_counts_: DataFrame, collocs: DataFrame,
                 include_sub_collocs: bool = False, vfunc: str | None = None) -> DataFrame:
    """Collocation features: multi-word n-grams listed in ``collocs(feat)``
    plus 1-grams.  Without sub-collocations, each word's count is reduced by
    the counts of the collocations that contain it (rows reaching 0 vanish)."""
    bc = ngram_counts_.join(collocs.select("feat").distinct(), "feat", "left_semi").select("group_id", "feat", "value")
    words = word_counts.select("group_id", "feat", "value")
    if not include_sub_collocs:
        sub = (bc.select("group_id", F.explode(F.split("feat", " ")).alias("feat"), "value")
               .groupBy("group_id", "feat").agg(F.sum("value").alias("_s")))
        words = (words.join(sub, ["group_id", "feat"], "left")
                 .select("group_id", "feat", (F.col("value") - F.coalesce("_s", F.lit(0.0))).alias("value"))
                 .where(F.col("value") > 0))
    return attach_group_norm(materialize(words.unionByName(bc)), vfunc, kept=True)


# Accent folding used by the vectorizer's preprocessing (ours).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def english_stop_words(spark) -> list:
    """Spark's built-in English stop-word list."""
    from pyspark.ml.feature import StopWordsRemover
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def tfidf_vectorizer(messages: DataFrame, ngram_range=(1, 3), min_df: float = 0.2, max_df: float = 0.8,
                     max_features: int = 200000, stop_words: list | None = None) -> DataFrame:
    """Vectorizer-style TF-IDF over each group's messages.

    lower-case + accent folding, tokens of 2+ letters/digits, stop words removed
    before n-grams, document-frequency bounds as shares of groups (inclusive),
    top ``max_features`` by corpus count (ties by name), smoothed
    ``idf = ln((1+n)/(1+df)) + 1``, ``w = tf * idf`` L2-normalized per group.
    ``value`` = tf, ``group_norm`` = normalized weight.
    """
    spark = messages.sparkSession
    stop = stop_words if stop_words is not None else english_stop_words(spark)
    text = F.translate(F.lower("message"), ACCENTED, UNACCENTED)
    m = messages.select("group_id", text.alias("_x"))
    toks = m.select("group_id", F.expr(r"regexp_extract_all(_x, '([\\p{L}\\p{N}]{2,})', 1)").alias("_t0"))
    toks = toks.select("group_id", (F.filter("_t0", lambda x: ~x.isin(*stop)) if stop else F.col("_t0")).alias("_t"))    # a hash set
    lo, hi = ngram_range
    grams = toks.select("group_id", F.explode(F.flatten(F.array(*[ngrams("_t", k) for k in range(lo, hi + 1)])))
                        .alias("feat"))
    tf = materialize(grams.groupBy("group_id", "feat").agg(F.count(F.lit(1)).cast("double").alias("tf")))   # read by vocabulary and weights
    n_docs = messages.select("group_id").distinct().count()
    vocab = tf.groupBy("feat").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_ctf"))
    vocab = vocab.where((F.col("_df") >= F.lit(min_df * n_docs)) & (F.col("_df") <= F.lit(max_df * n_docs)))
    vocab = vocab.orderBy(F.col("_ctf").desc(), F.col("feat").asc()).limit(max_features)
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("_df"))) + F.lit(1.0)
    # max_features rows at most are sent to the rows of tf
    w = materialize(tf.join(F.broadcast(materialize(vocab.select("feat", idf.alias("_idf")))), "feat").withColumn("_w", F.col("tf") * F.col("_idf")))
    norm = w.groupBy("group_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return (w.join(norm, "group_id")
            .select("group_id", "feat", F.col("tf").alias("value"),
                    (F.col("_w") / F.nullif(F.col("_norm"), F.lit(0.0))).alias("group_norm")))
