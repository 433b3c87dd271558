"""Helper names as input columns, odd archives, numerals, and models against their definitions."""

import gzip
import hashlib
import itertools
import math
import re
import zlib

import numpy as np

import corpus_pipeline
from glossa.llm import langid, linededup, mixing, tokencount, toxicity, urlrep, warc

# --- column names ------------------------------------------------------------


def test_urls_with_helper_names(spark):
    names = ["bad_lower", "_of", "_part", "host", "ruled", "isbad", "salt", "rule", "path", "verdict"]
    d = spark.createDataFrame([(f"http://a{i % 3}.org/{i}", *["x"] * len(names)) for i in range(9)],
                              "url string, " + ", ".join(f"{c} string" for c in names))
    rules = [urlrep.Rule("a1.org/", "block"), urlrep.Rule("a2.org/", "allow")]
    plain = urlrep.judge_urls(d.select("url"), rules).orderBy("url").collect()
    got = urlrep.judge_urls(d, rules)
    assert got.columns[:len(names) + 1] == d.columns and len(set(got.columns)) == len(got.columns)
    assert [r[-2] for r in got.orderBy("url").collect()] == [r["verdict"] for r in plain]
    assert all(r[c] == "x" for r in got.collect() for c in names)


def test_lines_with_helper_names(spark):
    line = "the same line stands on every site of them"
    rows = [(i, f"{line}\nown line number {i} of this text", f"s{i}", "x", "y", "z") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _bad_id string, bad_keys string, n_lines string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(d).collect()}
    assert all((line in r["text"]) == (i == 0) and r["_bad_id"] == "x" and r["n_lines"] == "z" for i, r in got.items())


def test_near_duplicates_with_helper_names(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t, "x", 1, 2), (2, t, "y", 3, 4), (3, "other words", "z", 5, 6), (3, "other words", "z", 5, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, _drop int, _again int")
    got = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert got.columns == d.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_mix_with_helper_names(spark):
    names = ["_of", "_low", "_high", "_per", "_of2", "_low2", "_nth", "_first", "_period", "_rs", "_lo", "_j", "block", "slot", "_rank"]
    rows = [(i, f"t{i}", f"s{i % 3}", *range(len(names))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    got = mixing.mix(d, block_docs=8)
    plain = mixing.mix(d.select("doc_id", "text", "source"), block_docs=8)
    assert sorted(r[:3] + (r[-1],) for r in got.collect()) == sorted(r[:3] + (r[-1],) for r in plain.collect())
    assert got.columns[:len(d.columns)] == d.columns


def test_trees_with_helper_names(spark):
    ranks = b"\n".join(__import__("base64").b64encode(bytes([i])) + b" %d" % i for i in range(256))
    d = spark.createDataFrame([(1, "a tree", "old", 7)], "doc_id long, text string, tree string, id int")
    r = tokencount.token_trees(d, ranks).first()
    assert r["tree"]["chars"] == [6] and r["tree"]["tokens"] == [6] and r["id"] == 7


# --- archives ----------------------------------------------------------------

def arc_file(bodies, head=b"HTTP/1.0 200 OK\nContent-Type: image/png\nX-Source-Key: %d\nContent-Length: %d\n\n"):
    out = [warc.arc_version_block(1, "old.arc", "19990101000000")]
    for k, b in enumerate(bodies):
        content = head % (k, len(b)) + b
        out.append(warc.arc_header(1, b"http://h/%d" % k, "19990101000000", "image/png", len(content)) + content)
    return b"\n".join(out) + b"\n"


def test_bare_line_feeds_binary_payloads_and_plain_files(spark, tmp_path):
    bodies = [bytes(range(256)) * 2, "Grüße".encode("latin-1") * 40, b"short\xff", bytes(range(256)) * 2, b""]
    for name, data in (("plain.arc", arc_file(bodies)), ("packed.arc.gz", gzip.compress(arc_file(bodies[::-1])))):
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_bytes(data)
        out = str(tmp_path / f"warc-{name}")
        warc.arc_to_warc(spark, str(folder), out)
        got = {r["key"]: r for r in warc.read_warc(spark, out).collect()}
        want = bodies if name == "plain.arc" else bodies[::-1]
        first = {}
        for k, b in enumerate(want):
            r = got[k]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
            seen = first.setdefault(b, k) if len(b) >= 100 else k
            assert (r["record_type"], r["refers_to"]) == (("response", None) if seen == k else ("revisit", seen))
        assert len(got) == len(bodies)


def test_blank_line_of_a_header():
    for head in (b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"HTTP/1.1 200 OK\nA: b\n\n", b"HTTP/1.1 200 OK\r\nA: b\n\r\n"):
        assert warc.split_http(head + b"body\r\n\r\nmore\n\n") == (head, b"body\r\n\r\nmore\n\n")
    assert warc.split_http(b"HTTP/1.0 200 OK") == (b"HTTP/1.0 200 OK", b"")


# --- models against their definitions ----------------------------------------

def test_numerals_are_no_letters():
    m = langid.Model(["en"], np.ones((1, 0)), np.ones((1, 0)), np.zeros((langid.DIM, 0)), np.zeros(0))
    texts = ["²", "½ 12", "Ⅷ", "٣", "_", "ª", "ж", "a", "", None, "語"]
    assert m.predict(texts)[0] == ["und", "und", "und", "und", "und", "en", "en", "en", "und", "und", "en"]


def test_decoding_by_hand():
    """Costs are sums over bits of reliability x logistic loss; the cheapest codeword wins."""
    rng = np.random.default_rng(3)
    langs = ["a", "b", "c"]
    code = langid.codewords(3)
    trust = rng.random(code.shape)
    trust /= trust.sum(1, keepdims=True)
    m = langid.Model(langs, code, trust, rng.normal(size=(langid.DIM, code.shape[1])), rng.normal(size=code.shape[1]))
    for text in ("some words here", "Ein Satz mit Wörtern", "x"):
        x = langid.features(text)
        cost = []
        for k in range(3):
            c = 0.0
            for j in range(code.shape[1]):
                f = sum(x[i] * m.weight[i, j] for i in range(langid.DIM)) + m.bias[j]
                c += trust[k, j] * math.log(1 + math.exp(-f * code[k, j]))
            cost.append(c)
        p = [math.exp(-(c - min(cost)) * code.shape[1]) for c in cost]
        lang, score, margin = m.predict([text])
        assert lang == [langs[int(np.argmin(cost))]] and np.isclose(score[0], max(p) / sum(p))
        assert np.isclose(margin[0], (sorted(p)[-1] - sorted(p)[-2]) / sum(p))


def test_features_by_hand():
    """Shares of hashed byte n-grams of one to four bytes."""
    raw = b" ab c "
    count = np.zeros(langid.DIM)
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            h = int.from_bytes(raw[i:i + n], "big")
            count[(h * int(langid._MUL[n - 1]) % (1 << 32)) >> 20] += 1
    assert np.allclose(langid.features("Ab,C") ** 2, count / count.sum())


def test_pairwise_term_by_hand():
    """Score of a factorization machine: bias, weights of present terms, and every pair's product of factors."""
    rng = np.random.default_rng(4)
    words = ["you", "people", "are", "terrible", "nice"]
    buckets = sorted({b for w in words for b in toxicity.term_buckets(w)})
    m = toxicity.Model({b: i for i, b in enumerate(buckets)}, -0.3, rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), toxicity.FACTORS)))
    for text in ("You people are terrible", "nice people", "nothing known", "", None, "you you you"):
        terms = set()
        for w in re.findall(r"\w+", (text or "").lower()):
            for t in [w, *[w[:n] + "*" for n in toxicity.STEMS if len(w) >= n]]:
                b = zlib.crc32(t.encode()) % toxicity.BUCKETS
                if b in m.index:
                    terms.add(m.index[b])
        z = m.bias + sum(m.weight[i] for i in terms) + sum(float(m.factor[i] @ m.factor[j]) for i, j in itertools.combinations(sorted(terms), 2))
        assert np.isclose(m.score(m.columns(text, {})), 1 / (1 + math.exp(-z)))
