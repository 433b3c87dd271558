"""Distributed ranking helpers.

A global ``row_number() over (order by ...)`` window runs in a single
task.  The row ids are pinned by a reliable checkpoint before they are
used twice (offsets and rows).  ``global_rank`` instead range-partitions the rows by the order,
numbers rows inside each partition with ``monotonically_increasing_id``
(partition index in the high bits, position in the low bits) and adds the
row count of all earlier partitions (a table with one row per partition,
so its broadcast is bounded by the partition count).

``rank_within`` numbers rows inside classes with the same machinery plus
per-class start offsets (one row per class), so a hot class is still
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import tidy

_LOW = 1 << 33


def scratch_path(spark, tag: str = "") -> str:
    """A new path in the session's shared checkpoint folder.  Only a session on a ``local``
    master without that setting gets a folder of its own (tests, single-machine runs)."""
    import uuid
    from glossa.session import checkpoint_dir, local_fallback_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = checkpoint_dir(spark, local_fallback_dir())
    return f"{base.rstrip('/')}/glossa-{tag + '-' if tag else ''}{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet into the session's shared checkpoint
    folder and read it back: cuts lineage and pins nondeterministic columns,
    so a retried stage (lost executor) or a second consumer sees exactly the
    same rows.  (A table write, not ``localCheckpoint``: it survives the loss
    of the executor that computed it.)"""
    path = scratch_path(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def global_rank(df: DataFrame, order_cols, out: str = "rn") -> DataFrame:
    """1-based position of each row in the total order ``order_cols``
    (make the order unique, e.g. end with a key column)."""
    s = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    s = materialize(s)
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid") % F.lit(_LOW))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_loc") + 1).cast("bigint"))
            .drop("_mid", "_pid", "_loc", "_off"))


def rank_within(df: DataFrame, class_cols, order_cols, out: str = "rn") -> DataFrame:
    """1-based position inside each class (``class_cols``), by ``order_cols``.

    Global position minus the class's first position; the first position is
    an aggregate (``min``), so no window spans a class.
    """
    keys = [class_cols] if isinstance(class_cols, str) else list(class_cols)
    g = global_rank(df, [F.col(k) for k in keys] + list(order_cols), "_g")
    starts = g.groupBy(*keys).agg(F.min("_g").alias("_start"))
    return (g.join(starts, keys).withColumn(out, (F.col("_g") - F.col("_start") + 1).cast("bigint"))
            .drop("_g", "_start"))


def average_rank(df: DataFrame, class_cols, value: str, out: str = "arank") -> DataFrame:
    """Average rank (ties share the mean of their positions) of ``value``
    inside each class.  The distinct values are counted and summed up in
    order, so a value shared by most rows is one row of the ranking; the join
    back is split by the skew handling of the session.  Rows without a
    value are left out."""
    keys = [class_cols] if isinstance(class_cols, str) else list(class_cols)
    return df.join(tie_ranks(df, keys, value, out), keys + [value])


def tie_ranks(df: DataFrame, keys: list, value: str, out: str = "arank") -> DataFrame:
    """The average rank of each distinct ``value`` of a class."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    below = running_sum(per, keys, [F.col(value)], "_c", "_below", inclusive=False)
    return below.select(*keys, value, (F.col("_below") + (F.col("_c") + 1) / 2.0).alias(out))


def top_k_per_key(df: DataFrame, key, order_cols, k: int, salt_col: str | None = None,
                  buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per key in two rounds: first per (key, salt bucket), then per
    key over at most ``buckets * k`` survivors, so a hot key is split."""
    keys = [key] if isinstance(key, str) else list(key)
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in ([salt_col] if salt_col else df.columns))), F.lit(buckets))
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    d = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)
    return d.withColumn(rank_col, F.row_number().over(w2).cast("bigint")).where(F.col(rank_col) <= k)


def prefix_sums(df: DataFrame, order_cols, value_cols, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``value_cols`` in the total order ``order_cols``.

    Range-partitioned and pinned like ``global_rank``; each partition's
    running sum is a window inside that partition only, plus the totals of
    all earlier partitions (one row per partition)."""
    s = materialize(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    tots = s.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tots.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in value_cols])
    wl = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = s.join(F.broadcast(offs), "_pid")
    for c in value_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_o_{c}") + F.sum(c).over(wl))
    return out.drop("_mid", "_pid", *[f"_o_{c}" for c in value_cols])


def running_extreme(df: DataFrame, class_cols, order_cols, value_col: str, how: str = "min",
                    direction: str = "suffix", out: str = "running") -> DataFrame:
    """Running min / max of ``value_col`` inside each class, in the order
    ``order_cols``: from the class start (prefix) or to the class end (suffix).

    Rows are range-partitioned by (class, order) and pinned; each partition
    computes its local running value, and the extreme of all later (suffix)
    or earlier (prefix) partitions of the same class is carried in from a
    table with one row per (partition, class)."""
    keys = [class_cols] if isinstance(class_cols, str) else list(class_cols)
    agg = F.min if how == "min" else F.max
    comb = F.least if how == "min" else F.greatest
    s = materialize(df.orderBy(*[F.col(k) for k in keys], *order_cols)
                    .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    o = F.col("_mid").desc() if direction == "suffix" else F.col("_mid").asc()
    wl = Window.partitionBy("_pid", *keys).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_loc", agg(value_col).over(wl))
    pc = s.groupBy("_pid", *keys).agg(agg(value_col).alias("_pe"))
    po = F.col("_pid").desc() if direction == "suffix" else F.col("_pid").asc()
    wc = Window.partitionBy(*keys).orderBy(po).rowsBetween(Window.unboundedPreceding, -1)
    carry = pc.select("_pid", *keys, agg("_pe").over(wc).alias("_carry"))
    return (s.join(carry, ["_pid"] + keys)
            .withColumn(out, comb(F.col("_loc"), F.coalesce(F.col("_carry"), F.col("_loc"))))
            .drop("_mid", "_pid", "_loc", "_carry"))


def running_sum(df: DataFrame, class_cols, order_cols, value_col: str, out: str = "cum",
                inclusive: bool = True) -> DataFrame:
    """Running sum of ``value_col`` inside each class in the order
    ``order_cols`` (inclusive or exclusive of the current row); partition-local
    windows plus carried totals of earlier partitions of the same class."""
    return running_sums(df, class_cols, order_cols, {out: value_col}, inclusive)


def running_sums(df: DataFrame, class_cols, order_cols, sums: dict, inclusive: bool = True) -> DataFrame:
    """``running_sum`` of several columns at once: ``sums`` gives the summed column of each new one."""
    keys = [class_cols] if isinstance(class_cols, str) else list(class_cols)
    s = materialize(df.orderBy(*[F.col(k) for k in keys], *order_cols)
                    .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    end = Window.currentRow if inclusive else -1
    wl = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, end)
    wc = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    local = {o: f"_loc{i}" for i, o in enumerate(sums)}
    pc = s.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_pt{i}") for i, c in enumerate(sums.values())])
    carry = pc.select("_pid", *keys, *[F.coalesce(F.sum(f"_pt{i}").over(wc), F.lit(0.0)).alias(f"_carry{i}") for i in range(len(sums))])
    s = s.select("*", *[F.coalesce(F.sum(c).over(wl), F.lit(0.0)).alias(local[o]) for o, c in sums.items()])
    return (s.join(carry, ["_pid"] + keys).withColumns({o: F.col(local[o]) + F.col(f"_carry{i}") for i, o in enumerate(sums)})
            .drop("_mid", "_pid", *local.values(), *[f"_carry{i}" for i in range(len(sums))]))
