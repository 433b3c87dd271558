"""Adaptive radix trees and the prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest

from glossa.llm import queries, radix


def test_tree_holds_every_string_through_all_layouts():
    rng = random.Random(3)
    for alphabet in (2, 10, 40, 256):
        keys = {bytes(rng.randrange(alphabet) for _ in range(rng.randrange(0, 6))) for _ in range(3000)}
        tree = radix.Tree()
        for k in keys:
            tree.slot(k).value = k
        found, todo = [], [(tree.root, b"")]
        while todo:
            node, path = todo.pop()
            path += node.prefix
            if node.value is not None:
                assert node.value == path
                found.append(path)
            assert node.value is not None or len(list(node.kids.items())) > 1 or node is tree.root
            todo += [(kid, path + bytes([b])) for b, kid in node.kids.items()]
        assert sorted(found) == sorted(keys)
        for k in keys:
            assert tree.slot(k).value == k


def test_layouts_grow():
    kids, seen = radix.Sorted(), []
    for i in range(256):
        kids = kids.put((i * 7) % 256, i)
        seen.append(type(kids).__name__ + str(getattr(kids, "room", "")))
        assert all(kids.get((j * 7) % 256) == j for j in range(i + 1))
    assert list(dict.fromkeys(seen)) == ["Sorted4", "Sorted16", "Indexed", "Direct"]
    assert [b for b, _ in kids.items()] == list(range(256))


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, name, text))
    convs = {c: [(x[1], x[3]) for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    nodes = {}
    for c, w in built.items():
        for d in range(len(w) + 1):
            nodes.setdefault(tuple(w[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])),
                    sum(q not in kids for q in below),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, up string, conv bigint"


def conversations():
    rng = random.Random(9)
    rows = [(None, 1, "user", "no id"), (None, None, None, None), (3, None, None, None), (3, None, "user", None), (3, 0, "user", "x"), (3, 0, "user", "x"),
            (-7, 1, "user", "minus"), (-5, 1, "user", "minus five"), (4, 0, "user", "é"), (4, 1, "a", "b"), (9, 2, "", "")]
    for c in range(20, 140):
        kind = rng.randrange(3)
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t if kind else rng.randrange(4), rng.choice(["user", "assistant", None]),
                         f"t{t}" if kind == 1 else rng.choice(["yes", "no", "maybe é"])))
    for c in range(200, 300):       # one conversation that a third of all shares
        rows += [(c, t, "user", f"hot {t}") for t in range(10)]
    rows += [(300, t, "user", f"long {t}") for t in range(120)]
    return rows


@pytest.mark.parametrize("size", [1 << 23, 2000, 150])
def test_trie_against_brute_force(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(radix, "RANGE_BYTES", size)
    rows = conversations()
    d = spark.createDataFrame([(*r, "n", "u", 5) for r in rows], SCHEMA).repartition(4)
    d.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_radix_trie"](spark, str(tmp_path))
    have = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert have == brute(rows)


def test_empty_table(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert radix.prefix_trie(radix.turn_lists(d)).count() == 0
