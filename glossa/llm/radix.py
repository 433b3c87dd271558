"""Prefix trie of conversations, built from adaptive radix trees over turn ids.

A turn's id is 16 bytes, the md5 of its role's length, role and text, read as one
big-endian number; a conversation is the string of its turns' ids.  The strings are
sorted over the whole table (string, then conversation) and cut into ranges; each range
becomes one adaptive radix tree (Leis, Kemper and Neumann, 2013): inner nodes hold 4, 16, 48
or 256 children and grow from one layout to the next, and bytes without a branch are
kept once as a node's prefix.  Walking a tree, only depths of whole turns (multiples
of 16 bytes) emit a trie node.

Ranges are cut by (string, conversation), so a string or prefix that a third of all
conversations share lies on many ranges.  A trie node that may go on in a neighbouring range (a
prefix of the range's last string, or of the last one before it) is emitted in parts,
which one combining aggregate adds up; all others are whole where they are found.  All figures of a
node are sums over ranges: a range counts a trie node only if the range before doesn't
hold it already, which that range's last string tells.  With N nodes of a subtree of which
F are the first child of their parent, N - F have no child; and the tokens saved are the sizes
of all turns of all members below the node, less those of the distinct nodes.

Defined results: a null role or text is empty; null turn numbers come first, turns of equal number
in order of role and text, rows repeated are turns of their own; rows with a null
conv_id belong to no conversation; a conversation without turns is a member of
the root; an empty table has no nodes.  Extra columns aren't read.  A conversation is one
row of 20 bytes a turn, its texts aside, so its length is bounded by what a row can hold.
The digest of the conversations that end at a node reads their ids in order, as
its definition asks, in one stream that holds one id at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, spread_join

WIDTH = 16                  # bytes of a turn id
RANGE_BYTES = 8 << 20       # of strings that one tree takes, about


# --- adaptive radix tree -----------------------------------------------------

class Sorted:
    """Children in order of their bytes: the layouts for 4 and for 16."""
    __slots__ = ("bytes", "kids", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.kids, self.room = bytearray(), [], room

    def get(self, byte: int):
        i = bisect_left(self.bytes, byte)
        return self.kids[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte: int, kid):
        """The layout that holds the child afterwards."""
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.kids[i] = kid
            return self
        if len(self.kids) == self.room:
            return (Sorted(16) if self.room == 4 else Indexed()).fill(self).put(byte, kid)
        self.bytes.insert(i, byte)
        self.kids.insert(i, kid)
        return self

    def fill(self, other):
        self.bytes, self.kids = bytearray(other.bytes), list(other.kids)
        return self

    def items(self):
        return zip(self.bytes, self.kids)


class Indexed:
    """An index of 256 places into up to 48 children."""
    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int):
        i = self.index[byte]
        return self.kids[i - 1] if i else None

    def put(self, byte: int, kid):
        i = self.index[byte]
        if i:
            self.kids[i - 1] = kid
            return self
        if len(self.kids) == 48:
            return Direct().fill(self).put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def fill(self, other):
        for byte, kid in other.items():
            self.put(byte, kid)
        return self

    def items(self):
        return ((b, self.kids[i - 1]) for b, i in enumerate(self.index) if i)


class Direct:
    """256 places."""
    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def fill(self, other):
        for byte, kid in other.items():
            self.kids[byte] = kid
        return self

    def items(self):
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """The bytes from the branch above to the one below, children and the value of the string that ends here."""
    __slots__ = ("prefix", "kids", "value")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.kids, self.value = prefix, Sorted(), value


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def slot(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if there is none."""
        node, at, above = self.root, 0, None
        while True:
            same, most = 0, min(len(node.prefix), len(key) - at)
            if node.prefix[:most] == key[at:at + most]:
                same = most
            else:
                same = next(i for i in range(most) if node.prefix[i] != key[at + i])
            if same < len(node.prefix):     # the prefix is cut in two
                upper = Node(node.prefix[:same])
                byte, node.prefix = node.prefix[same], node.prefix[same + 1:]
                upper.kids = upper.kids.put(byte, node)
                if above is None:
                    self.root = upper
                else:
                    above[0].kids = above[0].kids.put(above[1], upper)
                node = upper
            at += same
            if at == len(key):
                return node
            kid = node.kids.get(key[at])
            if kid is None:
                kid = Node(key[at + 1:])
                node.kids = node.kids.put(key[at], kid)
                return kid
            above, node, at = (node, key[at]), kid, at + 1


class Ending:
    """The conversations of a range whose string ends at a node, ascending."""
    __slots__ = ("ids",)

    def __init__(self):
        self.ids: list[int] = []


def digest(ids: Iterable[int]) -> str:
    """Digest of the ids in decimal, joined by commas."""
    sha, some = hashlib.sha256(), False
    for i in ids:
        sha.update(f",{i}".encode() if some else f"{i}".encode())
        some = True
    return sha.hexdigest()


#: What a trie node sums over the parts of its subtree.
SUMS = ["n_convs", "n_children", "n_nodes", "n_first", "all_bytes", "own_bytes"]


def _name(path: bytes) -> str:
    return hashlib.md5(path).hexdigest()


def walk(tree: Tree, size_of: dict[bytes, int], before: bytes | None, last: bytes) -> Iterator[dict]:
    """The trie nodes of a range's tree.  ``before`` is the last string of the range before,
    ``last`` that of this one; a node that is a prefix of either is open, it has parts elsewhere."""
    turns_before = -1 if before is None else len(before) // WIDTH

    def begin(path: bytes, depth: int) -> dict:
        held = before is not None and depth <= turns_before and before.startswith(path)
        return {"path": path, "depth": depth, "mine": not held, "open": held or last.startswith(path),
                "size": size_of[path[-WIDTH:]] if depth else 0, "least": None, "ids": [], "kids": [],
                "first": held and turns_before > depth, **dict.fromkeys(SUMS, 0)}   # first: seen already

    def end(rec: dict, above: dict | None) -> Iterator[dict]:
        rec["n_convs"] += len(rec["ids"])
        rec["n_nodes"] += rec["mine"]
        rec["own_bytes"] += rec["size"] * rec["mine"]
        rec["all_bytes"] += rec["size"] * rec["n_convs"]
        if rec["ids"] and (rec["least"] is None or rec["ids"][0] < rec["least"]):
            rec["least"] = rec["ids"][0]
        if above is not None:
            for c in SUMS:
                if c != "n_children":
                    above[c] += rec[c]
            above["n_children"] += rec["mine"]
            above["n_first"] += rec["mine"] and not above["first"]
            above["first"] = above["first"] or rec["mine"]
            if above["least"] is None or rec["least"] < above["least"]:
                above["least"] = rec["least"]
            above["kids"].append(rec)
        for kid in rec.pop("kids"):
            kid["parent"] = None if rec["open"] else rec["least"]
            kid["up"] = _name(rec["path"]) if rec["open"] else None
            yield kid

    stack: list[dict] = []                       # trie nodes on the way down from the root
    todo = [(tree.root, b"", None)]              # tree nodes, bytes above them, trie nodes above them once visited
    while todo:
        node, path, base = todo.pop()
        if base is not None:                     # everything below is done
            while len(stack) > base:
                rec = stack.pop()
                yield from end(rec, stack[-1] if stack else None)
                if not stack:
                    yield rec | {"parent": None, "up": None}
            continue
        todo.append((node, path, len(stack)))
        path += node.prefix
        while len(stack) * WIDTH <= len(path):   # only whole turns make a trie node
            stack.append(begin(path[:len(stack) * WIDTH], len(stack)))
        if node.value is not None:
            stack[-1]["ids"] = node.value.ids
        todo += [(kid, path + bytes([byte]), None) for byte, kid in reversed(list(node.kids.items()))]


_NODE = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.int64()), ("up", pa.string()),
                   ("node", pa.string()), *[(c, pa.int64()) for c in SUMS], ("sha", pa.string()), ("ends", pa.list_(pa.int64()))])


def _emitted(recs: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(recs, 10_000)):
        rows = [{"depth": r["depth"], "conv_id": r["least"], "parent": r["parent"], "up": r["up"],
                 "node": _name(r["path"]) if r["open"] else None, **{c: int(r[c]) for c in SUMS},
                 "sha": None if r["open"] else digest(r["ids"]), "ends": r["ids"] if r["open"] else []} for r in some]
        yield pa.RecordBatch.from_pylist(rows, _NODE)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges one after the other, each led by a row with the string before it."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("pid", "conv", "key", "sizes"))))
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        _, _, before, _ = next(group)
        tree, size_of, last = Tree(), {}, b""
        for _, conv, key, sizes in group:
            node = tree.slot(key)
            if node.value is None:
                node.value = Ending()
                size_of.update((key[i * WIDTH:(i + 1) * WIDTH], s) for i, s in enumerate(sizes))
            node.value.ids.append(conv)
            last = key
        yield from _emitted(walk(tree, size_of, before, last))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    out = ((k, digest(i for _, i in g)) for k, g in itertools.groupby(rows, key=lambda r: r[0]))
    while some := list(itertools.islice(out, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["node", "sha"])


# --- over the whole table ----------------------------------------------------

def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv, turns): the turns of each conversation in order, (id in hex, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.struct(F.col("turn"), role.alias("role"), name.alias("id"), F.octet_length(text).alias("size")).alias("t"))
    lists = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def prefix_trie(lists: DataFrame) -> DataFrame:
    """(conv, turns), each conv once -> a row per trie node: conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = lists.sparkSession
    scratch = Scratch(spark, "radix")
    strings = scratch.keep(lists.select("conv", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.size").alias("sizes")), "strings")
    total = strings.agg(F.sum(F.length("key") + WIDTH)).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES))
    ranges = scratch.keep(strings.repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv")
                          .withColumn("pid", F.spark_partition_id()), "ranges")
    lasts = ranges.groupBy("pid").agg(F.max("key").alias("key"))    # a row for each range
    before = lasts.select("pid", F.lit(None).cast("long").alias("conv"), F.lag("key").over(Window.orderBy("pid")).alias("key"),
                          F.lit(None).cast("array<int>").alias("sizes"), F.lit(0).alias("o"))
    led = ranges.select("pid", "conv", "key", "sizes", F.lit(1).alias("o")).unionByName(before)
    led = led.repartitionByRange(n, "pid").sortWithinPartitions("pid", "o", "key", "conv")
    schema = ("depth long, conv_id long, parent long, up string, node string, " + ", ".join(f"{c} long" for c in SUMS)
              + ", sha string, ends array<long>")
    nodes = scratch.keep(led.mapInArrow(_trees, schema), "nodes")
    scratch.drop("strings", "ranges")
    parts = nodes.where("node IS NOT NULL")
    ids = parts.select("node", F.explode("ends").alias("conv"))
    shas = ids.repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_digests, "node string, sha string")
    opened = (parts.groupBy("node").agg(F.max("depth").alias("depth"), F.max("up").alias("up"), F.min("conv_id").alias("conv_id"),
                                        *[F.sum(c).alias(c) for c in SUMS])
              .join(shas, "node", "left").withColumn("sha", F.coalesce("sha", F.lit(digest([])))))
    opened = scratch.keep(opened, "open")
    above = opened.select(F.col("node").alias("up"), F.col("conv_id").alias("parent"))
    cols = ["conv_id", "depth", "parent", *SUMS, "sha"]
    whole = nodes.where("node IS NULL")
    below = whole.where("up IS NOT NULL").drop("parent")    # children of an open node, perhaps of one that many share
    all_ = (whole.where("up IS NULL").select(*cols).unionByName(spread_join(below, above, ["up"], ["conv_id", "depth"]).select(*cols))
            .unionByName(opened.join(above, "up", "left").select(*cols)))
    return all_.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                       (F.col("n_nodes") - F.col("n_first")).alias("n_leaves"),
                       (F.col("all_bytes") - F.col("own_bytes")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
