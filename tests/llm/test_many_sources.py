"""Targets with many sources, and the layout of all phases against slot by slot scheduling."""

import random

import pytest

from glossa.llm import mixing
from tests.llm.test_small import docs_frame


@pytest.mark.parametrize("others", [19, 2000, 5000])
def test_targets_hold_with_many_sources(others):
    raw = {"hot": (10**7 / 3) ** 0.5} | {k: (10**7 * 2 / 3 / others) ** 0.5 for k in range(others)} | {"tiny": 1.0}
    w = mixing.scaled_weights(raw)
    for k in ("hot", 0, "tiny"):
        assert abs(w[k] / sum(w.values()) / (raw[k] / sum(raw.values())) - 1) < 0.02


def test_phases_against_slot_by_slot():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        w, blocks = [rng.randrange(1, rng.choice([4, 300])) for _ in range(n)], [rng.randrange(0, 60) for _ in range(n)]
        left, want = list(blocks), []
        while any(left):
            live = [s for s in range(n) if left[s]]
            total, k, t = sum(w[s] for s in live), dict.fromkeys(live, 0), 0
            while all(left[s] for s in live):
                s = min((-(-(k[s] + 1) * total // w[s]), s) for s in live if k[s] * total // w[s] <= t)[1]
                want.append(s)
                k[s] += 1
                left[s] -= 1
                t += 1
        got = {}
        for start, length, slots, of in mixing.phases(blocks, w):
            for s, (lo, hi, per) in of.items():
                at = [t for t, x in enumerate(slots) if x == s]
                for b in range(lo, hi):
                    got[start + (b - lo) // per * length + at[(b - lo) % per]] = s
        assert [got[t] for t in range(len(want))] == want and len(got) == len(want)


def test_mix_with_weights_beyond_a_hundred_thousand(spark, monkeypatch):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else f"s{i % 7}") for i in range(300)]
    weights = {"a": 200_000} | {f"s{k}": 20_000 for k in range(7)}
    for most in (100_000, 3):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        got = mixing.mix(docs_frame(spark, rows), weights, block_docs=2).collect()
        assert len(got) == 300 and len({r["mix_position"] for r in got}) == 300
        slot = {r["_slot"]: r["source"] for r in got}
        assert sorted(slot) == list(range(len(slot)))
        first = [slot[t] for t in range(100)]
        assert abs(first.count("a") - 100 * 200 / 340) < 1
