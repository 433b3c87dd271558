"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of ``block_docs``.  With the target
weight w, the source's i-th block (from 0) is released at floor(i / w) and
due at ceil((i + 1) / w); in every slot the released block with the earliest
deadline goes.  As the weights sum to one, every block meets its window, so
in any prefix of t slots a source has more than w t - 1 and less than w t + 1
blocks.

With integer weights that sum to Q the schedule repeats every Q slots, so it
is laid out once for one period, or up to the first end of a source where that
comes sooner, and the block's slot follows by arithmetic.  When a source has
used up its blocks, the schedule goes on, from that slot, with the weights
of those that remain: there are at most as many phases as sources.  The layout
has a row for each slot laid out, so never more than the corpus has blocks; the
driver also looks at every source that is left once a phase.  No document is
dropped or repeated.

Targets that are not given as integers are scaled to integers of ``LEAST_WEIGHT``
at least, whatever the number of sources: the period grows with them, and
every source has its share to about 2 %.  The bound of one block holds for the
integers.

Within a source, documents are in order of the md5 of their id.  Ranks come
from a window over (source, bucket of the md5) plus the offsets of the
buckets, so a source with a third of the rows is dealt over many tasks.

Defined results: a null source is a source of its own; a source without a
given weight gets ``default_weight``; repeated rows and null ids keep one
position each (their order among themselves is by text, then arbitrary).
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import fresh

#: Smallest integer weight of a scaled target: rounding moves it by 1 % at most.
LEAST_WEIGHT = 50
#: Rows of a layout that is broadcast; a larger one is joined by source and block.
BROADCAST_ROWS = 100_000
#: Rows that one window partition has at most, about.
BUCKET_ROWS = 50_000


def pfair_period(weights: Sequence[int], left: Sequence[int] | None = None) -> list[int]:
    """The source index of each slot of one period, by earliest deadline
    (ties: lower index) among the released blocks; with the blocks ``left`` of
    each source, no further than the last block of the source that ends first."""
    total = sum(weights)
    due = lambda i, w: -(-((i + 1) * total) // w)
    ready = [(due(0, w), s, 0) for s, w in enumerate(weights) if w]   # all are released at 0
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int, int]] = []   # by release
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, d, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (d, s, i))
        _, s, i = heapq.heappop(ready)
        slots.append(s)
        if left is not None and i + 1 == left[s]:
            break
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], due(i + 1, weights[s]), s, i + 1))
    return slots


def scaled_weights(raw: Mapping, period: int = 1000) -> dict:
    """Integer weights close to ``raw`` with a sum of about ``period``, or as
    much more as the smallest needs for ``LEAST_WEIGHT``."""
    total = sum(raw.values())
    period = max(period, LEAST_WEIGHT * total / min(raw.values()))
    return {k: round(period * v / total) for k, v in raw.items()}


def phases(n_blocks: Sequence[int], weights: Sequence[int]):
    """(first slot, length of the period, slots laid out, {source: (first block,
    end block, blocks a period)} of the sources with a slot) for every stretch in
    which the same sources have blocks left."""
    left = {s: n for s, n in enumerate(n_blocks) if n}
    done = dict.fromkeys(left, 0)
    start = 0
    while left:
        order = sorted(left)
        g = math.gcd(*(weights[s] for s in order))
        w = {s: weights[s] // g for s in order}
        length = sum(w.values())
        slots = [order[x] for x in pfair_period([w[s] for s in order], [left[s] for s in order])]
        where: dict[int, list[int]] = {}
        for t, s in enumerate(slots):
            where.setdefault(s, []).append(t)
        if len(slots) < length:
            end = len(slots)
        else:   # the slot after the last block of the source that ends first
            end = min(length * ((left[s] - 1) // w[s]) + at[(left[s] - 1) % w[s]] for s, at in where.items()) + 1
        full, rest = divmod(end, length)
        used = {s: full * w[s] + bisect.bisect_left(at, rest) for s, at in where.items()}
        yield start, length, slots, {s: (done[s], done[s] + n, w[s]) for s, n in used.items() if n}
        for s, n in used.items():
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += end


def rank_in_source(docs: DataFrame, sizes: Mapping, doc_id: str, source: str, text: str, rank: str) -> DataFrame:
    """Adds the rank, from 0, of a row in its source by (md5 of id, id, hash of text)."""
    md5, tie, bucket, skey, base, n = fresh(docs, "_md5", "_tie", "_bucket", "_skey", "_base", "_n")
    bits = max(0, math.ceil(math.log2(max(1, max(sizes.values(), default=1) / BUCKET_ROWS)))) + 4
    d = docs.select(
        "*", F.coalesce(F.md5(F.col(doc_id).cast("string")), F.md5(F.col(text)), F.lit("")).alias(md5),
        F.xxhash64(text).alias(tie),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias(skey)
    ).withColumn(bucket, F.substring(md5, 1, -(-bits // 4)))
    counted = d.groupBy(skey, bucket).agg(F.count("*").alias(n))
    # a row per source and bucket; the join and the window below share one shuffle on these two
    starts = counted.select(skey, bucket, (F.sum(n).over(Window.partitionBy(skey).orderBy(bucket)) - F.col(n)).alias(base))
    within = Window.partitionBy(skey, bucket).orderBy(md5, doc_id, tie)
    d = d.join(starts, [skey, bucket]).withColumn(rank, F.col(base) + F.row_number().over(within) - 1)
    return d.select(*[F.col(c) for c in docs.columns], F.col(rank))


def mix(docs: DataFrame, weights: Mapping | None = None, block_docs: int = 64, doc_id: str = "doc_id",
        source: str = "source", text: str = "text", default_weight: int = 1, temperature: float = 0.5) -> DataFrame:
    """``docs`` with block (number in its source), slot and mix_position
    (slot x block_docs + place in the block), whole and in that order's keys.

    Without ``weights`` the target of a source is its size to the power of
    ``temperature``.
    """
    spark = docs.sparkSession
    rank, block, slot, pos = fresh(docs, "_rank", "block", "slot", "mix_position")
    of1, low, high, per, of2, low2, nth_, first, period = fresh(docs, "_of", "_low", "_high", "_per", "_of2", "_low2", "_nth", "_first", "_period")
    # one row per source: configuration-sized
    sizes = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    if weights is None:
        scaled = scaled_weights({s: n ** temperature for s, n in sizes.items()}) if sizes else {}
    else:
        scaled = {s: int(weights.get(s, default_weight)) for s in order}
    if any(w < 1 for w in scaled.values()):
        raise ValueError("weights are positive integers")
    rows = []
    for start, length, slots, of in phases([-(-sizes[s] // block_docs) for s in order], [scaled[s] for s in order]):
        nth = dict.fromkeys(of, 0)
        for t, s in enumerate(slots):
            if s in of and nth[s] < of[s][1] - of[s][0]:   # else it has no such slot before this phase ends
                rows.append((order[s], *of[s], nth[s], start + t, length))
                nth[s] += 1
    small = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda x: x
    layout = spark.createDataFrame(rows, T.StructType([
        T.StructField("src", docs.schema[source].dataType), T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()), T.StructField("per", T.LongType()), T.StructField("j", T.LongType()),
        T.StructField("first_slot", T.LongType()), T.StructField("period", T.LongType())]))
    # phase of a block: a handful of ranges per source; then the slot by (phase, place in the period)
    ranges = layout.select("src", "lo", "hi", "per").distinct()
    d = rank_in_source(docs, sizes, doc_id, source, text, rank).withColumn(block, F.floor(F.col(rank) / block_docs))
    d = d.join(small(ranges.withColumnsRenamed({"src": of1, "lo": low, "hi": high, "per": per})),
               F.col(source).eqNullSafe(F.col(of1)) & (F.col(block) >= F.col(low)) & (F.col(block) < F.col(high)))
    d = d.join(small(layout.select(F.col("src").alias(of2), F.col("lo").alias(low2), F.col("j").alias(nth_),
                                   F.col("first_slot").alias(first), F.col("period").alias(period))),
               F.col(source).eqNullSafe(F.col(of2)) & (F.col(low) == F.col(low2))
               & ((F.col(block) - F.col(low)) % F.col(per) == F.col(nth_)))
    s = F.col(first) + F.floor((F.col(block) - F.col(low)) / F.col(per)) * F.col(period)
    return d.select(*[F.col(c) for c in docs.columns], F.col(block).cast("long").alias(block), s.cast("long").alias(slot),
                    (s * block_docs + F.col(rank) % block_docs).cast("long").alias(pos))
