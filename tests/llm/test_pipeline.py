"""The pipeline on planted documents, stage by stage against brute force; queries and oracles."""

import itertools
import math
import random
import re
import zlib

import pytest

import corpus_pipeline
from glossa.llm import decontam, toxicity
from tests.llm.test_small import DOCS, brute_sets, components, words


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [(k, words(rng, 25, 10_000)) for k in range(5)]
    line = "the same footer stands on every single site here"
    rows, labels, i = [], [], 0
    for _ in range(160):
        bad = rng.random() < 0.3
        text = words(rng, rng.randrange(20, 60), 3000) + (f" awful{rng.choice(['ly', 'ness', ''])}" if bad else "")
        if rng.random() < 0.15:
            text += " " + rng.choice(bench)[1] + " " + words(rng, 3)
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            t = text.split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = f"e{rng.randrange(9999)}"
            rows.append((i, " ".join(t) + (f"\n{line}" if rng.random() < 0.3 else ""), "en", f"s{rng.randrange(20)}"))
            labels.append((i, int(bad)))
            i += 1
    rows += [(None, "a row without an id", "en", "s1"), (9000, None, "en", "s1"), (9001, "", None, None), (9002, line, "en", "s3"), (5, rows[5][1], "en", "s4")]
    at = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(d, t, g, s, len(t or ""), "x", 7, "y", "z") for d, t, g, s in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def score_by_hand(model, text):
    """Bias, weights of the present terms and every pair's product of factors."""
    terms = set()
    for w in re.findall(r"\w+", (text or "").lower()):
        for t in [w, *[w[:n] + "*" for n in toxicity.STEMS if len(w) >= n]]:
            b = zlib.crc32(t.encode()) % toxicity.BUCKETS
            if b in model.index:
                terms.add(model.index[b])
    z = model.bias + sum(model.weight[i] for i in terms)
    z += sum(float(model.factor[i] @ model.factor[j]) for i, j in itertools.combinations(sorted(terms), 2))
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def lines_by_hand(rows):
    """Lines of 20 characters or more on ten sites, or of over 50 words in two documents, stay in the first document only;
    documents that lose all their text go."""
    seen = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            k = line.strip(" ").lower()
            if len(k) >= 20:
                seen.setdefault(k, []).append((r["doc_id"], r["source"]))
    gone = {}
    for k, at in seen.items():
        ids = {i for i, _ in at if i is not None}
        if len({s for _, s in at if s is not None}) >= 10 or len(k.split()) > 50 and len(ids) > 1:
            gone[k] = min(ids)
    out = []
    for r in rows:
        if r["doc_id"] is None or not r["text"]:
            out.append(r.asDict())
            continue
        lines = r["text"].split("\n")
        kept = [x for x in lines if gone.get(x.strip(" ").lower(), r["doc_id"]) == r["doc_id"]]
        if len(kept) == len(lines) or "\n".join(kept).strip(" "):
            out.append(r.asDict() | {"text": "\n".join(kept)})
    return out


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{planted}/{t}.parquet") for t in ("labels", "benchmark"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, result = docs, stage(spark, docs, planted)
        rows, was = sorted(result.collect(), key=key), sorted(before.collect(), key=key)
        out[name] = len(rows)
        if name == "mix":
            assert result.columns[:len(before.columns)] == before.columns and len(rows) == len(was)
            assert len({r["mix_position"] for r in rows}) == len(rows)
            break
        assert result.columns == before.columns
        if name == "toxicity":
            model = toxicity.train(before, labels)
            want = [r for r in was if score_by_hand(model, r["text"]) < 0.5]
        elif name == "line_dedup":
            want = lines_by_hand(was)
        elif name == "near_duplicates":
            sets = {}
            for r in was:
                if r["doc_id"] is not None:
                    sets.setdefault(r["doc_id"], set()).add(brute_sets(r["text"], 5))
            links = [(a, b) for a, b in itertools.combinations(sets, 2)
                     if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
            low = components(sets, links)
            seen, want = set(), []
            for r in was:
                same = (r["doc_id"], r["text"])
                if r["doc_id"] is None or (low[r["doc_id"]] == r["doc_id"] and not (same in seen and r["text"])):
                    want.append(r)
                seen.add(same)
        else:
            index = decontam.Index.of([(r["item_id"], s) for r in bench.collect() for _, s in decontam.segments(r["text"].encode())])
            want = [r for r in was if not (r["text"] and index.find(r["text"].lower().encode()))]
        assert [(r["doc_id"], r["text"]) for r in rows] == [(r["doc_id"], r["text"]) for r in want], name
        assert 0 < len(rows) < len(was), name
        docs = spark.createDataFrame(rows, result.schema)


def test_an_empty_table_stays_empty(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, planted).count() == 0


def test_one_query_for_each_operator():
    from glossa.llm import queries
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
