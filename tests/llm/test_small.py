"""Edge cases and brute-force comparisons on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from glossa.llm import decontam, embdedup, langid, linededup, minhash, mixing, tokencount, toxicity, urlrep, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept int, id string, slot string"


def docs_frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 7, "y", "z") for i, t, lang, s in rows], DOCS)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def components(nodes, links):
    low = {x: x for x in nodes}
    while True:
        again = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                again = True
        if not again:
            return low


# --- near duplicates ---------------------------------------------------------

def brute_sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def test_minhash_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(None, "null id text", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"),
            (4, "one", "en", "a"), (5, "ONE", "en", "b"), (6, "one two three", "en", "a"), (7, "one two three four five", "en", "a")]
    i = 10
    for _ in range(25):
        base = words(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy).upper() if i % 3 == 0 else "  ".join(copy), "en", "a"))
            i += rng.randrange(1, 3)
    rows.append((500, words(rng, 30_000, 10_000), "en", "a"))        # a very long text and its copy
    rows.append((499, rows[-1][1], "en", "a"))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_frame(spark, rows), width=4).collect()}
    assert len(got) == len(rows)
    sets = {r[0]: brute_sets(r[1], 4) for r in rows if r[0] is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    for d, s in sets.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(s), want[d], want[d] == d), d
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_minhash_large_group_is_one_component(spark):
    """Hundreds of near copies of one text: hub rounds and the last pairs agree with brute force."""
    rng = random.Random(8)
    base = words(rng, 60, 5000).split()
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en", "a"))
    sets = {r[0]: brute_sets(r[1], 4) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_frame(spark, rows), width=4).collect()}
    assert got == want


def test_minhash_repeated_ids_and_empty(spark):
    rng = random.Random(5)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, b, "en", "s"), (3, b, "en", "s")]
    got = [(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1)]
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_every_pair_within_the_distance_shares_a_bucket():
    rng = random.Random(6)
    for _ in range(300):
        wrong = set(rng.sample(range(minhash.K), minhash.H))
        chunks = [[i in wrong for i in range(c * minhash.CHUNK, (c + 1) * minhash.CHUNK)] for c in range(minhash.M)]
        assert min(sum(c) for c in chunks) <= 1


# --- embeddings --------------------------------------------------------------

def test_embeddings_against_brute_force(spark, monkeypatch):
    np = pytest.importorskip("numpy")
    monkeypatch.setattr(embdedup, "TILE", 16)     # crowded cells are cut into many tiles
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(40):
        c = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, [float(x) for x in c + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.3])]))
            i += 1
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]]), (902, [1e200 * x for x in rows[0][1]]), (903, [1e-200 * x for x in rows[0][1]])]
    odd = [(910, None), (911, [0.0] * 12), (912, [1.0, None] * 6), (913, [float("nan")] * 12), (914, [float("inf")] * 12),
           (915, []), (916, [1.0, 2.0]), (None, rows[0][1])]
    f = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id bigint, embedding array<double>, n bigint, vec string")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(f).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([np.array(v) / max(abs(np.array(v))) for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    ids = [r[0] for r in rows]
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    for k, d in enumerate(ids):
        assert (got[d]["n_links"], got[d]["component_id"], got[d]["kept"]) == (near[k].sum() - 1, want[d], want[d] == d)
    for d, _ in odd[:-1]:
        assert (got[d]["n_links"], got[d]["component_id"], got[d]["kept"]) == (0, d, True)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert embdedup.near_duplicates(f.where("vec_id < -1")).count() == 0


# --- lines ------------------------------------------------------------------

def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    shared = [f"this line number {k} stands on many sites" for k in range(8)]
    rows = [(None, shared[0] + "\nown", "en", "s0"), (1, None, "en", "s1"), (2, "", "en", "s2"), (3, shared[7], "en", None)]
    for i in range(10, 90):
        lines = [words(rng, 9) for _ in range(3)] + ["short"] + rng.sample(shared[:5], rng.randrange(0, 4))
        rng.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else f" {x} " for x in lines), "en", f"s{i % rng.randrange(1, 15)}"))
    f = docs_frame(spark, rows)
    sites, first = {}, {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" ").lower()
            if len(k) >= 20:
                if s is not None:
                    sites.setdefault(k, set()).add(s)
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    bad = {k for k, v in sites.items() if len(v) >= 10}
    assert 0 < len(bad) < len(shared)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(f).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        if not t:
            assert got[i]["text"] == t and got[i]["n_lines"] == got[i]["n_removed"] == 0
            continue
        keep = [x for x in t.split("\n") if i is None or (k := x.strip(" ").lower()) not in bad or first[k] == i]
        assert got[i]["text"] == "\n".join(keep)
        assert (got[i]["n_lines"], got[i]["n_removed"]) == (t.count("\n") + 1, t.count("\n") + 1 - len(keep))
        assert got[i]["kept"] == 7 and got[i]["slot"] == "z"
    assert linededup.dedup_lines(docs_frame(spark, [])).count() == 0


# --- decontamination --------------------------------------------------------

def edit_distance_anywhere(seg, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(seg):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_distance_is_the_edit_distance():
    import numpy as np
    rng = random.Random(1)
    for _ in range(200):
        seg = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        d, a, z = decontam.banded_distance(np.frombuffer(seg, np.uint8), np.frombuffer(text, np.uint8), -40, 60, 100)
        assert d == edit_distance_anywhere(seg, text)
        assert edit_distance_anywhere(seg, text[max(0, a):z]) == d


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzñé     "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    bench = [(k, text(rng.choice([30, 60, 95, 96, 97, 150, 300]))) for k in range(12)] + [(50, None), (51, ""), (52, "tiny"), (53, bytes(0).decode())]
    bench.append((54, bench[0][1]))
    rows = [(None, "x " + bench[3][1], "en", "a"), (1, None, "en", "a"), (2, "", "en", "a")]
    for i in range(10, 60):
        _, b = bench[rng.randrange(12)]
        b = list(b)
        for _ in range(rng.randrange(0, len(b) // 8)):
            p = rng.randrange(len(b))
            b[p:p + rng.randrange(0, 2)] = rng.choice(letters)
        b = "".join(b)
        rows.append((i, text(rng.randrange(0, 200)) + " " + (b.upper() if i % 2 else b) + "; " + text(rng.randrange(0, 200)), "en", "a"))
    rows += [(70, text(200_000) + bench[5][1] + text(1000), "en", "a"), (71, text(500), "en", "a")]
    f = docs_frame(spark, rows)
    b = spark.createDataFrame([(*r, "extra") for r in bench], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(f, b).collect()}
    fold = lambda t: decontam.fold(t.lower().encode())[0].tobytes()
    want = {}
    for i, t, _, _ in rows:
        for k, s in bench:
            if not t or len(t) > 10_000:
                continue
            for _, seg in decontam.segments(s.lower().encode()) if s else ():
                d = edit_distance_anywhere(seg, fold(t))
                if d <= decontam.budget(len(seg)):
                    want[i, k] = min(d, want.get((i, k), 99))
    assert {k: v for k, v in got.items() if k[0] != 70} == want
    assert (70, 5) in got and (None, 3) in got
    flagged = {i for i, _ in got}
    left = decontam.clean_documents(f, b)
    assert left.columns == f.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r[0] for r in rows if r[0] not in flagged)
    assert decontam.contaminated(f, b.where("item_id < 0")).count() == 0
    assert decontam.contaminated(docs_frame(spark, []), b).count() == 0


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    bench = [(k, words(rng, 30, 5000)) for k in range(9)]
    rows = [(i, words(rng, 20) + " " + bench[i % 9][1] + " " + words(rng, 5), "en", "a") for i in range(12)]
    f, b = docs_frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")
    one = sorted(map(tuple, decontam.contaminated(f, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK_SEGMENTS", 7)
    assert sorted(map(tuple, decontam.contaminated(f, b).collect())) == one and len(one) >= 12
    assert decontam.clean_documents(f, b).count() == 0


# --- url reputation ---------------------------------------------------------

RULES = [urlrep.Rule("org/", "allow"), urlrep.Rule("example.org/es/", "block"), urlrep.Rule("com/de/", "block"), urlrep.Rule("com/fr/", "allow")]


def test_url_rules_and_odd_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/1?q"), (2, "https://x.org"), (3, None), (4, "no scheme"), (5, ""), (6, "http://b.com/de/#x"),
            (7, "http://notexample.org/es/"), (8, "x://h.com/fr/a://b"), (None, "http://b.com/de/"), (9, "http://b.com/en/"), (9, "http://b.com/en/")]
    f = spark.createDataFrame([(*r, "v") for r in rows], "page_id bigint, url string, verdict string")
    got = urlrep.judge_urls(f, RULES).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["_verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2]["rule"] is None and by[2]["path"] == ""
    for k in (3, 4, 5):
        assert (by[k]["host"], by[k]["path"], by[k]["rule"]) == ("", "", None)
    assert by[7]["rule"] == "org/" and by[8]["rule"] == "com/fr/" and by[8]["path"] == "/fr/a://b"
    assert by[9]["_verdict"] == "block"       # all labelled pages of b.com are bad
    none = urlrep.judge_urls(f.where("page_id IN (3, 4)"), RULES).collect()
    assert {r["_verdict"] for r in none} == {"allow"}
    assert urlrep.judge_urls(f.where("page_id < 0"), RULES).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("a.good.com", 200, 2), ("b.good.com", 150, 0), ("new.good.com", 1, 1), ("c.bad.com", 180, 170), ("d.bad.com", 160, 155),
            ("new.bad.com", 1, 1), ("none.bad.com", 0, 0), ("x.other.net", 0, 0)]
    got = {r["host"]: r for r in urlrep.host_reputation(spark.createDataFrame(rows, "host string, n bigint, k bigint")).collect()}
    assert got["new.good.com"]["bad_mean"] < got["none.bad.com"]["bad_mean"] < got["new.bad.com"]["bad_mean"]
    assert got["new.good.com"]["bad_lower"] < 0.5 < got["new.bad.com"]["bad_mean"]
    overall = sum(k for _, _, k in rows) / sum(n for _, n, _ in rows)
    assert math.isclose(got["x.other.net"]["bad_mean"], overall)
    assert all(r["bad_lower"] <= r["bad_mean"] for r in got.values())


# --- archives ---------------------------------------------------------------

def test_arc_headers_of_both_versions():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\n\r\nline\nline\n"
        data = warc.arc_version_block(version, "a b.arc", "20240101000000")
        data += warc.arc_header(version, warc.url_field("http://a/b c"), "199912312359", "text/html", len(body)) + body + b"\n"
        data += b"not a header\n" + warc.arc_header(version, b"dns:a", "20200101000000", "text/dns", 5) + b"12345\n"
        data += warc.arc_header(version, b"http://cut/", "20200101000000", "text/html", 99) + b"short"
        recs = list(warc.parse_arc(data))
        assert [r.version for r in recs] == [version] * 4
        assert recs[1].content == body and recs[1].url == "http://a/b%20c"
        assert recs[2].content == b"12345" and recs[3].truncated
        back = list(warc.parse_warc(b"\r\n\r\n".join(warc.to_warc(r) for r in recs)))
        assert [f["warc-type"] for f, _ in back] == ["warcinfo", "response", "resource", "resource"]
        assert back[1][1] == body and back[1][0]["warc-date"] == "1999-12-31T23:59:00Z"
        assert back[3][0]["warc-truncated"] == "length"
        assert len({f["warc-record-id"] for f, _ in back}) == 4


@pytest.mark.parametrize("version", [1, 2])
def test_pages_round_trip(spark, version):
    big = "é" * 60
    rows = [(1, "http://a", big), (2, "http://b c\n", big), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""),
            (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nhttp://x 0 20200101000000 a 5\n" * 9), (8, "u", "line\r\n\r\n" * 40), (9, "u", "line\r\n\r\n" * 40),
            (None, "u", big), (11, "u", "z" * 300_000), (12, "u", "z" * 300_000), (12, "u", "z" * 300_000)]
    f = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, key string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.page_records(f, version).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        rev = i is not None and h in first and first[h] != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if rev else "response", first[h] if rev else None))
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    assert warc.page_records(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- toxicity and language --------------------------------------------------

def remainder(i):
    return zlib.crc32(str(i).encode()) % 5


def test_factorization_machine_learns_pairs():
    import numpy as np
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append([k for k, on in ((0, a), (1, b)) if on] + [int(k) for k in 2 + np.nonzero(rng.random(6) < 0.3)[0]])
        y.append(float(a != b))          # no additive weights can tell this
    y = np.array(y)
    m = toxicity.Model({}, *toxicity.fit(rows, y, np.ones(len(y)), 8, epochs=60))
    right = np.mean([(m.score(r) >= 0.5) == (t == 1) for r, t in zip(rows, y)])
    assert right > 0.95


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        rows.append((i, words(rng, 40) + (f" Vile{rng.choice(['ness', 'st', 'ly', ''])} " if bad else " ") + words(rng, 5), "en", "a"))
        labels.append((i, int(bad)))
    rows += [(1000, None, "en", "a"), (1001, "", None, None), (None, "vile", "en", "a"), (1002, words(rng, 30_000), "en", "a"), (1, rows[1][1], "en", "a")]
    f = docs_frame(spark, rows)
    lab = spark.createDataFrame([*((*x, 1) for x in labels), (None, 1, 1), (1001, None, 1)], "doc_id bigint, toxic int, score int")
    model = toxicity.train(f, lab)
    got = toxicity.scores(f, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    truth = dict(labels)
    held = [i for i in truth if remainder(i) == 0]
    assert {i for i in truth if by[i]["held_out"]} == set(held)
    assert sum(by[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95
    assert by[1000]["score"] == by[1001]["score"] and not by[None]["held_out"]
    kept = toxicity.keep_clean(f, model)
    assert kept.columns == f.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    for empty in (lab.where("doc_id < 0"), lab.where("toxic = 0")):
        assert {r["score"] < 1e-9 for r in toxicity.scores(f, toxicity.train(f, empty)).collect()} == {True}
    assert toxicity.scores(docs_frame(spark, []), toxicity.train(docs_frame(spark, []), lab)).count() == 0


def test_codewords():
    for n in (2, 3, 4, 5, 9, 40):
        c = langid.codewords(n)
        d = min((c[a] != c[b]).sum() for a in range(n) for b in range(a))
        assert len(c) == n and d >= (1 if n == 2 else 2 if n == 3 else 3)
        assert all(abs(col.sum()) < n for col in c.T)


def test_features_of_long_texts_are_whole():
    import numpy as np
    rng = random.Random(5)
    t = "".join(rng.choice("abcdé ") for _ in range(langid._PIECE * 2 + 777))
    whole = langid.features(t)
    old, langid._PIECE = langid._PIECE, 1 << 24
    try:
        assert np.allclose(whole, langid.features(t))
    finally:
        langid._PIECE = old


def test_language_held_out_and_odd_rows(spark):
    rng = random.Random(6)
    parts = {"aa": "ka lo mi ti", "bb": "sch ung ver ein", "cc": "eau oux tre ment", "dd": "cion ñar osa ado", "ee": "szy prz czy owa", "ff": "kkä tta ssi nen"}
    rows = [(i, " ".join("".join(rng.choice(parts[k].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), k, "s")
            for i, k in enumerate(rng.choice(sorted(parts)) for _ in range(500))]
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 34 !", None, "s"), (None, "schung verein", "aa", "s"),
           (1003, "schung verein " * 30_000, None, "s"), (1, rows[1][1], "aa", "s")]
    f = docs_frame(spark, rows + odd)
    model = langid.train(f)
    got = langid.identify(f, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows if remainder(r[0]) == 0]
    assert sum(by[i]["lang_pred"] == k for i, _, k, _ in held) / len(held) > 0.95
    assert all(by[i]["held_out"] == (remainder(i) == 0) for i, *_ in rows)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003]["lang_pred"] == by[None]["lang_pred"] == "bb"
    one = f.where("lang = 'aa' AND doc_id < 900")
    assert {r["lang_pred"] for r in langid.identify(f.where("doc_id < 900"), langid.train(one)).collect()} == {"aa"}
    assert {r["lang_pred"] for r in langid.identify(f, langid.train(f.where("doc_id < 0"))).collect()} == {"und"}
    assert langid.identify(docs_frame(spark, []), model).count() == 0


# --- mixing -----------------------------------------------------------------

@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [97, 1, 1, 1], [7, 7, 7, 1, 13], list(range(1, 25))])
def test_pfair_lag_stays_below_one_block(weights):
    slots, total = mixing.pfair_period(weights), sum(weights)
    assert [slots.count(s) for s in range(len(weights))] == weights
    done = [0] * len(weights)
    for t, s in enumerate(slots, 1):
        done[s] += 1
        assert all(abs(w * t / total - d) < 1 for w, d in zip(weights, done))


def test_mix_is_whole_and_on_target(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", "en", rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(700)]
    rows += [(None, "n1", "en", "b"), (None, "n2", "en", "b"), (5, "t5", "en", "a"), (5, "other", "en", "a")]
    f = docs_frame(spark, rows)
    weights = {"a": 3, "b": 2, None: 1}
    got = mixing.mix(f, weights, block_docs=7).collect()
    assert len(got) == len(rows) and len({r["mix_position"] for r in got}) == len(rows)
    assert sorted(r["text"] for r in got) == sorted(r[1] for r in rows)
    slot = {}
    for r in got:
        assert slot.setdefault(r["_slot"], r["source"]) == r["source"] and r["slot"] == "z"
    assert sorted(slot) == list(range(len(slot)))
    # brute force: earliest deadline first, phase by phase
    order = [None, "a", "b", "c"]
    order = sorted(order, key=lambda s: (s is None, s))
    left = {s: -(-sum(r[3] == s for r in rows) // 7) for s in order}
    w = {s: weights.get(s, 1) for s in order}
    seq = []
    while any(left.values()):
        live = [s for s in order if left[s]]
        total, n, t = sum(w[s] for s in live), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            due = [(-(-(n[s] + 1) * total // w[s]), k, s) for k, s in enumerate(live) if n[s] * total // w[s] <= t]
            s = min(due)[2]
            seq.append(s)
            n[s] += 1
            left[s] -= 1
            t += 1
    assert [slot[k] for k in range(len(slot))] == seq
    # inside a source by the md5 of the id
    a = sorted((r for r in got if r["source"] == "c"), key=lambda r: r["mix_position"])
    assert [r["doc_id"] for r in a] == sorted((r["doc_id"] for r in a), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert mixing.mix(docs_frame(spark, [])).count() == 0


# --- token counts -----------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def test_tree_after_edits_equals_a_full_count(ranks):
    enc = tokencount.encoder(ranks)
    count = lambda s: len(enc.encode_ordinary(s))
    rng, letters = random.Random(1), "ab \n'st9!é\t  \x1c"
    for _ in range(400):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 900)))
        parts = tokencount.leaves(t)
        assert "".join(parts) == t
        tree = tokencount.TokenTree(parts, [count(p) for p in parts], count)
        assert tree.total == count(t)
        for _ in range(4):
            a = rng.randrange(-2, len(t) + 3)
            b = a + rng.randrange(0, rng.choice([2, 30, 600]))
            new = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 6)))
            tree.edit(a, b, new)
            a, b = max(0, min(a, len(t))), max(0, min(b, len(t)))
            t = t[:a] + new + t[max(a, b):]
            assert tree.text() == t and tree.total == count(t)


def test_edits_on_a_table(spark, ranks):
    enc = tokencount.encoder(ranks)
    long = "many words of a long text " * 4000
    rows = [(1, None, None), (2, "", [(0, 0, "new words")]), (3, "plain text", None), (4, "a b c d", [(2, 3, "XX"), (None, 1, "q"), (0, 1, None)]),
            (5, long, [(50_000, 50_003, "Q")]), (None, "null id", [(0, 4, "x")]), (6, "overlap here", [(0, 5, "A"), (3, 9, "B")]), (3, "plain text", None)]
    f = spark.createDataFrame([(*r, "t") for r in rows], "doc_id bigint, text string, edits array<struct<start: int, stop: int, replacement: string>>, tokens string")
    got = tokencount.apply_edits(tokencount.token_trees(f, ranks), ranks).collect()
    assert len(got) == len(rows)
    for r in got:
        src = next(t for i, t, _ in rows if i == r["doc_id"])
        want = src
        for s, e, new in tokencount.ordered([dict(zip(("start", "stop", "replacement"), x)) for x in next(x for i, _, x in rows if i == r["doc_id"]) or ()]):
            want = (want or "")[:s] + new + (want or "")[e:]
        assert r["new_text"] == want
        assert r["n_tokens"] == len(enc.encode_ordinary(src or "")) and r["tokens_after"] == len(enc.encode_ordinary(want or ""))
        assert sum(r["new_tree"]["tokens"]) == r["tokens_after"] and sum(r["new_tree"]["chars"]) == len(want or "")
        if r["doc_id"] == 5:
            assert r["encoded_chars"] < 2000
    assert tokencount.token_trees(f.where("doc_id < 0"), ranks).count() == 0


def test_replacements_are_those_of_re_sub(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab1 2é") for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(99, None)]
    f = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F
    for r in f.withColumn("e", tokencount.replacements(F.col("text"), r"\d+", "#")).collect():
        t = r["text"]
        for s, e, new in tokencount.ordered(r["e"]):
            t = t[:s] + new + t[e:]
        assert t == (None if r["text"] is None else re.sub(r"\d+", "#", r["text"]))


def test_minhash_families_that_share_a_passage_fall_apart(spark, monkeypatch):
    """Documents that share 150 words and differ in 45 (similarity about 0.6): no pair of them
    is confirmed beyond the hubs', though every two meet in several buckets."""
    rng = random.Random(8)
    passage = words(rng, 150, 10**6)
    rows = [(i, passage + " " + words(rng, 45, 10**6)) for i in range(1000)]
    rows += [(i + 1000, passage + " " + t.split(" ", 150)[150] + " end") for i, t in rows[::100]]
    made = []
    linked = minhash._Join.linked

    def counted(self, pairs, name):
        made.append(pairs.count())
        return linked(self, pairs, name)
    monkeypatch.setattr(minhash._Join, "linked", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4)
    comp = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert comp == {i: (i - 1000 if i >= 1000 else i) for i, _ in rows}
    assert len(made) == minhash.ROUNDS + 1 and all(m <= len(rows) for m in made[:-1]) and made[-1] <= len(rows)


def test_minhash_families_without_a_hub_stay_whole(spark):
    """Copies whose common original is missing: no hub is near all of them."""
    rng = random.Random(12)
    rows, i = [], 0
    for _ in range(4):
        base = words(rng, 200, 10**6).split()
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(200)] = rng.choice(["aa", "bb", f"x{rng.randrange(10**6)}"])
            rows.append((i, " ".join(copy)))
            i += 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4)
    sets = {i: brute_sets(t, 4) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(list(sets), links)
    have = {r["doc_id"]: r["component_id"] for r in got.collect()}
    missed = [l for l in links if have[l[0]] != have[l[1]]]
    assert all(want[i] == want[c] for i, c in have.items()) and len(missed) <= len(links) * 1e-3


def test_minhash_variants_that_are_almost_near_make_few_pairs(spark, monkeypatch):
    """A family whose members are at a similarity of about 0.7 to each other, some of them linked; the original is
    missing: far fewer pairs than the family's square, and every link of the full sets."""
    rng = random.Random(31)
    base = words(rng, 300, 10**6).split()
    rows = []
    for i in range(300):
        copy = list(rng.choice(rows)[1].split() if i % 10 == 9 else base)
        for _ in range(4 if i % 10 == 9 else 7):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    made = []
    linked = minhash._Join.linked

    def counted(self, pairs, name):
        made.append(pairs.count())
        return linked(self, pairs, name)
    monkeypatch.setattr(minhash._Join, "linked", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4)
    sets = {i: brute_sets(t, 4) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(list(sets), links) and links
    assert made[-1] <= 300 * 299 / 2 / 3
