"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature is K = 70 minima of its shingle set, 14 bits each.  It
is cut into m = 14 chunks of 5 symbols.  Two signatures that differ in at most
H = 27 symbols have, by the pigeonhole principle, a chunk that differs in at
most floor(27 / 14) = 1 symbol; each chunk is therefore entered five times in the
index, each time with one symbol masked, and every pair within H meets in at
least one bucket.  At a Jaccard similarity of 0.8 a symbol differs with
probability 0.2, and the distance exceeds H with probability below 1e-4.
Pairs within H are confirmed on the full shingle sets.

Documents with equal sets are one class with one entry in the index.  Buckets
are not expanded into their pairs.  In each of ROUNDS rounds a document is compared with
one hub, a member of the largest component among those that share its buckets;
what this joins needs no further comparison, and buckets with one component are done.
The buckets that are left are split by exact filters, which a pair of different components
within the thresholds always passes:

* a symbol counts for a document only if another component has it in the same place, and
  K - H symbols must count;
* a shingle counts only if another component has it, and the share of the similarity
  (percent of the document's own shingles) must count;
* in the order of rarity (shingles that don't count first) the pair shares one of the first
  shingles that the similarity leaves to both (prefix and position filter).

So documents that share a passage without being near, a third of all rows perhaps, fall apart before
any pair is made.  A family of variants that are almost near shares most of its rare shingles, too.  What is left is
therefore compared with a last hub, and those that have the same hub are held against each other by how they differ
from it, shingles missing and added: of linked documents' differences one is missing from the other at most as
often as the similarity allows, so the pair shares one of the first differences in the order of rarity (two
without a common one are linked with the hub if they are linked at all).  The rest meets by the shingles' own order,
hub by hub.  A pair that is made is compared once.

Words are runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return, after lower-casing A-Z.  Defined results: a
document without words (null, empty, blank) has no shingles and links with
nothing; one with fewer words than ``width`` has the whole sequence as its
one shingle; a null id links with nothing and is kept; rows that repeat an id
are one node, linked with all that any of the rows links with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import Scratch, spread_join
from glossa.llm.components import connected_components

K, CHUNK, H = 70, 5, 27
M = K // CHUNK
WORDS = -(-K // 4)      # 64-bit words that hold a signature, four symbols each
#: Rounds in which every document is compared with one hub.
ROUNDS = 2
assert H // M == 1, "one masked symbol covers one error in a chunk"

_rng = np.random.default_rng(20_241)
MUL = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split() if text else []   # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    acc = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    """K symbols of 14 bits in WORDS words, in lanes of 15; the set is taken in pieces, so memory is bounded."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        low = np.minimum(low, (s[a:a + 4096] * MUL[:, None] + ADD[:, None]).min(axis=1))
    out = np.zeros(4 * WORDS, np.uint64)
    out[:K] = _mix(low) & np.uint64(0x3FFF)
    return (out.reshape(WORDS, 4) << np.uint64(15) * np.arange(4, dtype=np.uint64)).sum(axis=1).view(np.int64)


def _sign(batches, width):
    for b in batches:
        n, key, sig = [], [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            s = shingles(t, width)
            n.append(len(s))
            key.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            sig.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.string()),
                                          pa.array(sig, pa.list_(pa.int64()))], ["id", "n", "key", "sig"])


def _sets(batches, width):
    for b in batches:
        out = [shingles(t, width).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
        cls = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in out], pa.string())
        off = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flat = np.concatenate(out) if out else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), cls, pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                                         ["id", "cls", "items"])


def _symbol(sig: Column, i: int) -> Column:
    return F.shiftrightunsigned(sig[i // 4], 15 * (i % 4)).bitwiseAND(F.lit(0x3FFF))


def bucket_keys(sig: Column) -> Column:
    """The masked chunks of a signature: one 64-bit key for each chunk and masked symbol."""
    keys = []
    for c in range(M):
        part = [_symbol(sig, c * CHUNK + i) for i in range(CHUNK)]
        for skip in range(CHUNK):
            keys.append(F.xxhash64(F.lit(c * CHUNK + skip), *[p for i, p in enumerate(part) if i != skip]))
    return F.array(*keys)


def symbol_distance(a: Column, b: Column) -> Column:
    """Number of symbols that differ.  Adding all ones to the 14 bits of a lane sets
    its free 15th bit exactly where the lane isn't zero."""
    ones, flags = (sum(x << 15 * i for i in range(4)) for x in (0x3FFF, 0x4000))
    lanes = [F.bit_count((a[i].bitwiseXOR(b[i]) + F.lit(ones)).bitwiseAND(F.lit(flags))) for i in range(WORDS)]
    return sum(lanes[1:], lanes[0])


class _Join:
    """The state of one run: representatives of classes, their buckets, links and components."""

    def __init__(self, docs: DataFrame, scratch: Scratch, reps: DataFrame, width: int, percent: int):
        self.scratch, self.reps, self.percent = scratch, reps, percent
        keys = reps.select("rep", F.explode(bucket_keys(F.col("sig"))).alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        shared = scratch.keep(shared, "shared")     # read back, so that a key of many rows can be split in the join
        self.left = scratch.keep(keys.join(shared.hint("merge"), "key"), "buckets")
        need = self.left.select(F.col("rep").alias("id")).distinct()
        schema = docs.select("id").schema.add("cls", "string").add("items", T.ArrayType(T.LongType()))
        self.sets = scratch.keep(docs.join(need.hint("merge"), "id", "left_semi").mapInArrow(lambda b: _sets(b, width), schema), "sets")
        self.link_schema = reps.select(F.col("rep").alias("u"), F.col("rep").alias("v")).schema

    def may_link(self, u: str, v: str) -> Column:
        """Sizes that allow the similarity, and signatures within the distance."""
        nu, nv = F.col(f"n{u}"), F.col(f"n{v}")
        return (100 * F.least(nu, nv) >= self.percent * F.greatest(nu, nv)) & (
            symbol_distance(F.col(f"s{u}"), F.col(f"s{v}")) <= H)

    def signed(self, side: str) -> DataFrame:
        return self.reps.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}"))

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v), each given once, that are within the distance and whose sets pass."""
        near = (pairs.join(self.signed("u").hint("merge"), "u").join(self.signed("v").hint("merge"), "v")
                .where(self.may_link("u", "v")).select("u", "v").distinct())
        both = (near.join(self.sets.select(F.col("id").alias("u"), F.col("items").alias("iu")).hint("merge"), "u")
                .join(self.sets.select(F.col("id").alias("v"), F.col("items").alias("iv")).hint("merge"), "v"))
        inter = F.size(F.array_intersect("iu", "iv"))
        both = both.select("u", "v", inter.alias("i"), (F.size("iu") + F.size("iv")).alias("t"))
        return self.scratch.keep(both.where(100 * F.col("i") >= self.percent * (F.col("t") - F.col("i")))
                                 .select("u", "v").distinct(), f"links/{name}")

    def links(self) -> DataFrame:
        """All links so far, as one table."""
        path = self.scratch.path("links")
        return self.scratch.spark.read.schema(self.link_schema).option("recursiveFileLookup", "true").parquet(path)

    def labelled(self, comp: DataFrame | None) -> DataFrame:
        """(key, rep, comp, size) of the buckets that are left.  In the first round every rep is its own and
        its size is that of all its buckets together: the member that most others meet is the hub, the
        original of a family of copies if it is there."""
        if comp is None:
            weight = self.left.groupBy("rep").agg(F.sum("c").alias("size"))
            return self.left.select("key", "rep").join(weight.hint("merge"), "rep").withColumn("comp", F.col("rep"))
        return (self.left.join(comp.hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
                .withColumn("size", F.coalesce("size", F.lit(1))))

    def hub_round(self, k: int, comp: DataFrame | None) -> DataFrame:
        """Links of every document with one hub; leaves the buckets of several components."""
        lab = self.labelled(comp)
        order = F.struct(-F.col("size"), F.xxhash64("rep", F.lit(k)), F.col("rep").alias("hub"), F.col("comp").alias("of"))
        hubs = (lab.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min(order).alias("h"))
                .where("a <> b").select("key", "h.hub", "h.of"))
        hubs = self.scratch.keep(hubs, f"hubs{k}")
        here = self.scratch.keep(lab.join(hubs.hint("merge"), "key"), f"here{k}")
        often = here.where("comp <> of").groupBy("rep", "hub").agg(F.count("*").alias("c"))
        pairs = often.groupBy(F.col("rep").alias("u")).agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("v"))
        self.left = here.select("key", "rep")
        return self.linked(pairs, str(k))

    def merged(self, comp: DataFrame | None, k: int) -> DataFrame:
        """(rep, comp, size) after a few steps along a round's links between the components so far (None: every
        rep is its own): the smallest id among neighbours and theirs, and that one's.  Not always the whole
        closure; what is still apart is only compared once more."""
        links = self.scratch.spark.read.schema(self.link_schema).parquet(self.scratch.path(f"links/{k}"))
        if comp is not None:
            for side in ("u", "v"):
                links = (links.join(comp.select(F.col("rep").alias(side), F.col("comp").alias("c")).hint("merge"), side, "left")
                         .withColumn(side, F.coalesce("c", side)).drop("c"))
        both = links.where("u <> v")
        both = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))
        two = (both.join(one.select(F.col("u").alias("v"), F.col("low").alias("of")).hint("merge"), "v").groupBy("u").agg(F.min("of").alias("of"))
               .join(one.hint("merge"), "u").select(F.col("u").alias("rep"), F.least("low", "of").alias("comp")))
        jump = two.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        new = two.join(jump.hint("merge"), "comp", "left").select("rep", F.coalesce("next", "comp").alias("comp")).where("rep <> comp")
        if comp is not None:
            to = new.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
            moved = comp.select("rep", "comp").join(to.hint("merge"), "comp", "left").select("rep", F.coalesce("next", "comp").alias("comp"))
            new = moved.unionByName(new.join(comp.select("rep").hint("merge"), "rep", "left_anti"))
        new = self.scratch.keep(new, f"new{k}")
        sizes = new.groupBy("comp").agg((F.count("*") + 1).alias("size"))      # and the one it is named after
        return self.scratch.keep(new.join(sizes.hint("merge"), "comp").select("rep", "comp", "size")
                                 .unionByName(sizes.select(F.col("comp").alias("rep"), "comp", "size")
                                              .join(new.select("rep").hint("merge"), "rep", "left_anti")), f"comp{k}")

    def apart(self, comp: DataFrame) -> DataFrame:
        """(rep, cls, comp, n) in buckets of several components with enough symbols that another one has."""
        lab = self.labelled(comp)
        mixed = lab.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        mixed = self.scratch.keep(mixed, "mixed")
        self.left = self.scratch.keep(lab.join(mixed.hint("merge"), "key", "left_semi").select("key", "rep"), "last")
        here = lab.join(mixed.hint("merge"), "key", "left_semi").select("rep", "comp").distinct()
        here = self.reps.select("rep", "sig", "n", F.col("key").alias("cls")).join(here.hint("merge"), "rep")
        symbols = here.select("rep", "cls", "comp", "n", F.posexplode(F.array(*[_symbol(F.col("sig"), i) for i in range(K)])).alias("place", "symbol"))
        two = (symbols.groupBy("place", "symbol").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
               .where("a <> b").select("place", "symbol"))
        two = self.scratch.keep(two, "symbols")
        good = symbols.join(two.hint("merge"), ["place", "symbol"], "left_semi").groupBy("rep", "cls", "comp", "n").agg(F.count("*").alias("c"))
        return self.scratch.keep(good.where(F.col("c") >= K - H).drop("c"), "apart")

    def differences(self, apart: DataFrame, comp: DataFrame) -> tuple:
        """The pairs (u, v) of reps and their last hubs, and (rep, cls, comp, n, items, hub, diff): the class of the hub that a rep is held against and the shingles that one of
        both has.  Among the hubs of its buckets that it meets at least half as often as any, the first of one order,
        so that a family has one; it is its own, without differences, if they are half of both sets."""
        lab = self.labelled(comp).join(apart.select("rep").distinct().hint("merge"), "rep", "left_semi").select("key", "rep", "size")
        order = F.struct(-F.col("size"), F.xxhash64("rep", F.lit(ROUNDS)), F.col("rep").alias("hub"))
        hubs = lab.groupBy("key").agg(F.min(order).alias("h"))
        often = lab.join(hubs.hint("merge"), "key").groupBy("rep", "h").agg(F.count("*").alias("c"))
        often = often.withColumn("most", F.max("c").over(Window.partitionBy("rep")))
        to = self.scratch.keep(often.where(2 * F.col("c") >= F.col("most")).groupBy("rep").agg(F.min("h").alias("h"))
                               .select("rep", "h.hub"), "to")
        sets = (self.sets.join(apart.select(F.col("rep").alias("id"), "cls", "comp", "n").hint("merge"), ["id", "cls"])
                .groupBy("id", "cls", "comp", "n").agg(F.first("items").alias("items")).withColumnRenamed("id", "rep"))
        sets = self.scratch.keep(sets, "whole")
        one = sets.groupBy("rep").agg(F.min(F.struct("cls", "items")).alias("o"))     # a repeated id may have several
        one = one.join(to.select(F.col("hub").alias("rep")).distinct().hint("merge"), "rep", "left_semi")
        one = self.scratch.keep(one.select(F.col("rep").alias("hub"), F.col("o.cls").alias("of"), F.col("o.items").alias("its")), "one")
        both = spread_join(sets.join(to.hint("merge"), "rep", "left"), one, ["hub"], ["rep"])
        diff = F.concat(F.array_except("items", "its"), F.array_except("its", "items"))
        both = both.select("rep", "cls", "comp", "n", "of", "items", diff.alias("diff"), F.size("its").alias("k"))
        near = F.coalesce(2 * F.size("diff") <= F.col("n") + F.col("k"), F.lit(False))
        none = F.array().cast("array<long>")
        diffs = self.scratch.keep(both.select("rep", "cls", "comp", "n", "items", F.when(near, F.col("of")).otherwise(F.col("cls")).alias("hub"),
                                              F.when(near, F.col("diff")).otherwise(none).alias("diff")), "differences")
        return to.where("rep <> hub").select(F.col("rep").alias("ru"), F.col("hub").alias("rv")), diffs

    def ordered(self, each: DataFrame, on: list[str], size: str, name: str) -> DataFrame:
        """The items that several components have (``on``: what names one) with the rep's count ``m`` of these and
        their ``place`` in the order of rarity, behind the rep's other items."""
        each = self.scratch.keep(each, f"each{name}")
        seen = (each.groupBy(*on).agg(F.count("*").alias("df"), F.min("comp").alias("a"), F.max("comp").alias("b"))
                .where("a <> b").select(*on, "df"))
        seen = self.scratch.keep(seen, f"seen{name}")
        by = Window.partitionBy("rep", "cls")
        return (each.join(seen.hint("merge"), on).withColumn("m", F.count("*").over(by))
                .withColumn("place", F.col(size) - F.col("m") + F.row_number().over(by.orderBy("df", "item"))))

    def prefixes(self, diffs: DataFrame) -> DataFrame:
        """(item, hub, rep, comp, n, place): the shingles, in order of rarity, one of which the pair shares."""
        need = F.ceil(self.percent * F.col("n") / 100)
        ranked = self.ordered(diffs.select("rep", "cls", "comp", "n", "hub", F.explode("items").alias("item")), ["item"], "n", "")
        return self.scratch.keep(ranked.where((F.col("m") >= need) & (F.col("place") <= F.col("n") - need + 1))
                                 .select("item", "hub", "rep", "comp", "n", "place"), "prefixes")

    def variants(self, diffs: DataFrame) -> DataFrame:
        """Pairs (u, v) of one hub whose differences from it may be near."""
        each = diffs.select("rep", "cls", "comp", "n", "hub", F.size("diff").alias("s"), F.explode("diff").alias("item"))
        ranked = self.ordered(each, ["hub", "item"], "s", "d")
        first = ranked.where(self.percent * (F.col("place") - 1) <= (100 - self.percent) * F.col("n"))
        first = self.scratch.keep(first.select("hub", "item", "rep", "comp", "n", "s", "place"), "first")
        a, b = (first.select("hub", "item", *[F.col(c).alias(c[0] + x) for c in ("rep", "comp", "n", "s", "place")]) for x in "uv")
        share = F.least(F.expr("su - pu"), F.expr("sv - pv")) + 1
        return a.join(b.hint("merge"), ["hub", "item"]).where(F.expr("ru < rv AND cu <> cv") & (
            (100 + self.percent) * (F.expr("su + sv") - 2 * share) <= (100 - self.percent) * F.expr("nu + nv")))

    def remaining(self, comp: DataFrame) -> DataFrame:
        """Links between components that the hubs didn't find."""
        hubs, diffs = self.differences(self.apart(comp), comp)
        p = self.prefixes(diffs)
        groups = p.select("item", "hub").distinct()
        groups = self.scratch.keep(groups.select("item", F.col("hub").alias("hu")).join(
            groups.select("item", F.col("hub").alias("hv")).hint("merge"), "item").where("hu < hv"), "groups")
        a, b = (p.select("item", F.col("hub").alias("h" + x), *[F.col(c).alias(c[0] + x) for c in ("rep", "comp", "n", "place")]) for x in "uv")
        share = F.least(F.expr("nu - pu"), F.expr("nv - pv")) + 1
        pairs = groups.join(a.hint("merge"), ["item", "hu"]).join(b.hint("merge"), ["item", "hv"]).where(
            F.expr("ru <> rv AND cu <> cv") & ((100 + self.percent) * share >= self.percent * F.expr("nu + nv")))
        pairs = hubs.unionByName(pairs.select("ru", "rv")).unionByName(self.variants(diffs).select("ru", "rv"))
        return self.linked(pairs.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "last")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    linked doc_id), kept (it is that one)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    signed = scratch.keep(docs.mapInArrow(
        lambda b: _sign(b, width), docs.select("id").schema.add("n", "long").add("key", "string").add("sig", T.ArrayType(T.LongType()))),
        "signed")
    linkable = signed.where("n > 0 AND id IS NOT NULL")
    classes = scratch.keep(linkable.groupBy("key", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"),
                                                            F.count("*").alias("c")), "classes")
    # only classes of several rows have another representative than the row itself
    shared = classes.where("c > 1").select("key", F.col("rep").alias("of"))
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("id"))
    members = scratch.keep(spread_join(signed.select("id", "n", "key"), shared, ["key"], ["id"])
                           .select("id", "n", F.when(own.isNotNull(), F.coalesce("of", "id")).alias("rep")), "members")
    scratch.drop("signed")
    # an id that repeated rows put into several classes ties them together
    ties = (members.where("rep IS NOT NULL AND id IS NOT NULL").groupBy("id")
            .agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b"))
    ties = ties.select(F.col("id").alias("u"), F.col("a").alias("v")).unionByName(
        ties.select(F.col("id").alias("u"), F.col("b").alias("v")))
    several = members.where("rep IS NOT NULL AND id IS NOT NULL").select("id", "rep").distinct()
    several = several.join(ties.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
    edges = several.select(F.col("id").alias("u"), F.col("rep").alias("v"))

    job = _Join(docs, scratch, classes, width, percent)
    comp = None
    for k in range(ROUNDS):
        job.hub_round(k, comp)
        comp = job.merged(comp, k)
    job.remaining(comp)
    edges = edges.unionByName(job.links())
    comp = connected_components(edges, scratch, "all")
    scratch.drop("sets", "buckets", "last", "whole", "one", "differences", "each", "eachd", "first", "groups", "prefixes", *[f"{t}{k}" for k in range(ROUNDS) for t in ("here", "new", "comp", "hubs")])
    out = spread_join(members, comp.select(F.col("id").alias("rep"), "component"), ["rep"], ["id"])
    one = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), one.alias("component_id"),
                      F.coalesce(F.col("id") == one, F.lit(True)).alias("kept"))
