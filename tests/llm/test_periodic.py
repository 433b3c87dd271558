"""Periodic runs: tiles, stitching and collapsed texts against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from glossa.llm import periodic


def brute_runs(w):
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.append((i, j - i + q, q))
            i = j
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found))


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def stitched(frag):
    runs = {}
    for q, a, e in sorted(frag):
        last = runs.setdefault(q, [])
        if last and a <= last[-1][1]:
            last[-1][1] = max(last[-1][1], e)
        else:
            last.append([a, e])
    return sorted((a, e - a + q, q) for q, xs in runs.items() for a, e in xs if e - a + q >= max(24, 3 * q))


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(0, 30))]
        z = periodic.z_function(s)
        assert z == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("seed", range(6))
def test_fragments_make_the_runs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        w = []
        while len(w) < rng.randrange(20, 500):
            kind = rng.randrange(4)
            if kind == 0:
                w += [rng.randrange(1000) for _ in range(rng.randrange(1, 60))]
            elif kind == 1:
                p = [rng.randrange(50) for _ in range(rng.choice([1, 2, 3, 7, 8, 15, 16, 17, 31, 32, 40]))]
                w += (p * 60)[:rng.randrange(1, 7) * len(p) + rng.randrange(len(p) + 1)]
            elif kind == 2:
                w += [rng.randrange(2) for _ in range(rng.randrange(10, 80))]
            else:       # a run of runs
                p = [1] * rng.randrange(8, 40) + [2]
                w += p * rng.randrange(2, 6)
        assert stitched(periodic.fragments(np.array(w, np.int64))) == brute_runs(w)


def test_constant_text_has_one_run():
    assert stitched(periodic.fragments(np.zeros(30_000, np.int64))) == [(0, 30_000, 1)]


def rows():
    rng = random.Random(7)
    out = [(None, "a b " * 30), (None, None), (1, None), (2, ""), (3, " \t\r\n\x0b "), (4, "x " * 23), (5, "x " * 24), (5, "x " * 24),
           (6, "a b c d " * 20), (7, "é ü " * 40 + "end")]
    for i in range(10, 90):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 400))]
        if i % 3 == 0:
            base = base[:40] + base[40:70] * rng.randrange(1, 6) + base[70:]
        out.append((i, " ".join(base)))
    out.append((90, " ".join(f"v{i % 9000}" for i in range(40_000))))
    return out


FIELDS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_collapse_against_brute_force(spark):
    data = rows()
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in data], "doc_id bigint, text string, row int, found string, period string")
    got = periodic.collapse(d.repartition(5), change=periodic.periodic_tail)
    have = sorted((tuple(r[c] for c in FIELDS) for r in got.collect()), key=repr)
    want = sorted((brute(i, t) for i, t in data[:-1]), key=repr)
    big = [r for r in have if r[0] == 90]
    assert [r for r in have if r[0] != 90] == want
    assert len(big) == 1 and (big[0][2:5] == (0, 40_000, 9000) or zlib.crc32(b"90") % 10 == 0)


def test_collapsed_text_is_given(spark):
    d = spark.createDataFrame([(11, "one two three " * 10 + "end")], "doc_id bigint, text string")
    r = periodic.collapse(d).first()
    assert (r["collapsed"], r["n_words"], r["start"], r["length"], r["period"]) == ("one two three end", 31, 0, 30, 3)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic.collapse(d).count() == 0
