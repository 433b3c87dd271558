"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.llm import decontam, embdedup, langid, linededup, minhash, mixing, periodic, radix, tokencount, toxicity, trigrams, urlrep, warc
from glossa.llm.common import read, ship_package

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def deco(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


_LINES_SQL = """
WITH l AS (SELECT doc_id, source, lower(trim(line)) AS k FROM (
             SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
           WHERE length(trim(line)) >= 20),
bad AS (SELECT k, min(doc_id) AS first_id FROM l GROUP BY k HAVING count(DISTINCT source) >= 10),
d AS (SELECT l.doc_id, count(*) AS gone FROM l JOIN bad USING (k) WHERE l.doc_id <> first_id GROUP BY l.doc_id),
t AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i,
             unnest(string_split(text, chr(10))) AS line FROM documents),
kept AS (SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.i) AS text FROM t
         LEFT JOIN bad ON bad.k = lower(trim(t.line)) AND length(trim(t.line)) >= 20
         WHERE bad.k IS NULL OR bad.first_id = t.doc_id GROUP BY t.doc_id)
SELECT x.doc_id, coalesce(kept.text, '') AS text,
       CAST(CASE WHEN coalesce(x.text, '') = '' THEN 0 ELSE len(string_split(x.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(d.gone, 0) AS BIGINT) AS n_removed
FROM documents x LEFT JOIN kept USING (doc_id) LEFT JOIN d USING (doc_id)
"""


@query("op2_line_spread", _LINES_SQL)
def line_spread(spark, sf_dir):
    """Documents without lines that stand on ten sites or more (first copy stays),
    as its SQL has it: long lines have no threshold of their own."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.dedup_lines(d, long_words=None).select("doc_id", "text", "n_lines", "n_removed")


URL_RULES = [urlrep.Rule("org/", "allow"), urlrep.Rule("example.org/es/", "block"),
             urlrep.Rule("example.org/en/1", "block"), urlrep.Rule("com/fr/", "allow"),
             urlrep.Rule("com/de/", "block")]

_URL_SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM b),
p AS (SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
                     WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM c),
h AS (SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
             count(ruled)::DOUBLE AS n, count(*) FILTER (ruled = 'block')::DOUBLE AS k FROM p GROUP BY host),
seen AS (SELECT * FROM h WHERE n > 0),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM seen GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
mu AS (SELECT sum(k) / sum(n) AS mu FROM s),
levels AS (SELECT 1 AS lv, '' AS parent, n, k FROM s UNION ALL SELECT 2, suffix, n, k FROM d
           UNION ALL SELECT 3, suffix || ' ' || domain, n, k FROM seen),
par AS (SELECT lv, parent, count(*) AS m, sum(n) AS nn, sum(k) AS kk, sum(n * n) AS n2, sum(k * k / n) AS k2,
               sum(k) / sum(n) * (1 - sum(k) / sum(n)) AS v FROM levels GROUP BY lv, parent),
st AS (SELECT lv, 1 / least(greatest(CASE WHEN sum((nn - n2 / nn - (m - 1)) * v) > 0
              THEN sum(k2 - kk * kk / nn - (m - 1) * v) / sum((nn - n2 / nn - (m - 1)) * v) ELSE 0 END, 0.001), 0.999) - 1
              AS s FROM par GROUP BY lv),
one AS (SELECT max(s) FILTER (lv = 1) AS s1, max(s) FILTER (lv = 2) AS s2, max(s) FILTER (lv = 3) AS s3 FROM st),
sm AS (SELECT suffix, (k + s1 * mu) / (n + s1) AS sm FROM s, one, mu),
dm AS (SELECT domain, (k + s2 * sm) / (n + s2) AS dm FROM d JOIN sm USING (suffix), one),
post AS (SELECT host, k + s3 * coalesce(dm, sm, mu) AS a, n - k + s3 * (1 - coalesce(dm, sm, mu)) AS b
         FROM h LEFT JOIN dm USING (domain) LEFT JOIN sm USING (suffix), one, mu),
low AS (SELECT host, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_lower FROM post)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN round(bad_lower, 9) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN low USING (host)
"""


@query("op5_host_reputation", _URL_SQL)
def host_reputation(spark, sf_dir):
    """Rule or reputation verdict of every page url; the rules' verdicts are the labelled outcomes."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlrep.judge_urls(p, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_subspace_join", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = v.vec_id) AS n_links, c AS component_id,
       v.vec_id = c AS kept FROM v JOIN comp ON comp.id = v.vec_id""")
def subspace_join(spark, sf_dir):
    """Links and component of every vector at cosine 0.95."""
    return embdedup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op10_hamming_index", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def hamming_index(spark, sf_dir):
    """Near-duplicate components of all documents on four-word shingles."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


@query("op8_pfair_mix")
def pfair_mix(spark, sf_dir):
    """Slot and position of every document; target weights go with the square root of the sources' sizes."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(d).select("doc_id", "source", "block", "slot", "mix_position")


@query("op1_output_codes")
def output_codes(spark, sf_dir):
    """Language of every whole text."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(d, langid.train(d))


@query("op4_qgram_bands")
def qgram_bands(spark, sf_dir):
    """Documents that hold a benchmark passage, with the item and the stretch."""
    return decontam.contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                 read(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op7_factorization_machine")
def factorization_machine(spark, sf_dir):
    """Toxicity score of every whole text."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scores(d, toxicity.train(d, read(spark, sf_dir, "labels")))


@query("op6_arc_to_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND n >= 100""")
def arc_to_warc(spark, sf_dir):
    """Every page as a WARC record converted from ARC, read back."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.page_records(p).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Where the rank file lies; personal data that the edits of the query replace.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PERSONAL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]|\+\d+ \(\d+\) \d+-\d+|\b\d{16}\b|password=\S+"


@query("op9_edit_counts")
def edit_counts(spark, sf_dir):
    """Tokens of every document before and after its personal data is replaced."""
    ranks = tokencount.read_ranks(spark, RANKS)
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumn("edits", tokencount.replacements(F.col("text"), PERSONAL, "[removed]"))
    return tokencount.apply_edits(tokencount.token_trees(d, ranks), ranks).select(
        "doc_id", "n_chars", "n_tokens", "n_edits", "tokens_after", "encoded_chars")


# crc32 of a decimal number, as an expression over its digits
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x) + 1), lambda i: ord(substr(x, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""


def _crc(of):
    return _CRC.replace("x,", f"{of},").replace("length(x)", f"length({of})")


@query("op11_periodic_tiles", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc("doc_id::VARCHAR")} END AS h FROM documents),
t AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
u AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM t),
v AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) AS w FROM u),
x AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM v),
q AS (SELECT v.r, n, s.q, i FROM v, unnest(range(1, n // 3 + 1)) AS s(q), unnest(range(n - s.q)) AS j(i) WHERE n >= 24 AND w[i + 1] = w[i + s.q + 1]),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM q),
m AS (SELECT r, q, min(i) AS s, count(*) + q AS m FROM g GROUP BY r, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.r = m.r AND o.q < m.q AND o.s <= m.s AND o.s + o.m >= m.s + m.m)),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY m::DOUBLE / q DESC, s, q) AS k FROM runs),
per AS (SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS c FROM x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY x.r)
SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.m AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.m // best.q AS BIGINT) AS exponent_milli,
       coalesce(per.sha, sha256('')) AS runs_sha256, sha256(coalesce(kept.c, '')) AS collapsed_sha256
FROM v LEFT JOIN best ON best.r = v.r AND best.k = 1 LEFT JOIN per ON per.r = v.r LEFT JOIN kept ON kept.r = v.r""")
def periodic_tiles(spark, sf_dir):
    """Periodic runs of words of every whole text, with the tails that the contract repeats."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.collapse(d, change=periodic.periodic_tail).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query("op12_radix_trie", f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY i) AS own, {_crc("c::VARCHAR")} % 9 AS h FROM t GROUP BY c),
b AS (SELECT l.c, list_concat(coalesce(o.own[1:l.h], []), l.own[l.h + 1:]) AS w FROM l LEFT JOIN l AS o ON o.c = l.c - l.c % 5),
p AS (SELECT c, w, len(w) AS n, d, w[1:d] AS path FROM b, unnest(range(len(w) + 1)) AS s(d)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(path[d].text)) END AS size,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT a.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved
      FROM m AS u, unnest(range(u.d + 1)) AS x(e), m AS a WHERE a.path = u.path[1:x.e] GROUP BY a.path)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN m AS o ON m.d > 0 AND o.path = m.path[1:m.d - 1]""")
def radix_trie(spark, sf_dir):
    """The prefix trie of all conversations, each led by the first turns of its group of five."""
    lists = radix.turn_lists(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    base = lists.select(F.col("conv").alias("of"), F.slice("turns", 1, 8).alias("lead"))
    h = (F.crc32(F.col("conv").cast("string")) % 9).cast("int")
    none = F.slice("turns", 1, F.lit(0))
    both = lists.join(base, F.col("conv") - F.col("conv") % 5 == F.col("of"), "left")
    return radix.prefix_trie(both.select("conv", F.concat(
        F.coalesce(F.slice("lead", F.lit(1), h), none),
        F.slice("turns", h + 1, F.greatest(F.array_size("turns") - h, F.lit(0)))).alias("turns")))


#: What can begin a match of each kind; the rest of a text is passed over in one step.
_STARTS = {"assign": "PpSsTtAa", "access": "A", "hex": "0-9a-f", "pem": "-", "jwt": "e", "forge": "g", "chat": "x",
           "maps": "A", "payment": "rs", "login": ":"}


def _secrets_sql():
    one = []
    for n, r in enumerate(trigrams.RULES):
        tokens = f"(?s:({r.pattern})|[^{_STARTS[r.kind]}]+|.)".replace("'", "''")
        judged = f"regexp_extract(tok, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})"
        one.append(f"""SELECT r, {n} AS o, '{r.kind}' AS kind, upto - length(tok) AS s, upto AS e FROM (
          SELECT r, tok, sum(length(tok)) OVER (PARTITION BY r ORDER BY i) AS upto FROM (
            SELECT r, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{tokens}') AS toks FROM d)))
        WHERE regexp_full_match(tok, '{r.pattern.replace(chr(39), chr(39) * 2)}') AND length({judged}) >= {r.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join(one)}),
b AS (SELECT r, o, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM a),
g AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
             string_agg(x, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(x, ',' ORDER BY s, o) AS spans FROM b GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


@query("op13_trigram_secrets", _secrets_sql())
def trigram_secrets(spark, sf_dir):
    """Spans of credentials in every whole text."""
    d = trigrams.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["order"] < len(trigrams.BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(n):
        return F.array_size(F.filter("secrets", lambda s: s["order"] == n)).cast("long")
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
