"""Secret scans over an inverted index of trigrams.

A rule is a regular expression.  From its parse tree a Boolean query over trigrams of
the lower-cased text is derived: alternatives of sets of trigrams, one of which every
text with a match must hold in full (Cox, 2012: Regular Expression Matching with a Trigram
Index).  The index has a posting (trigram, key) for each distinct text that holds the
trigram, the key being a hash of the text; ``trigram_index`` posts all trigrams, or those
named.  A rule's postings are intersected by counting, for each key and alternative, how
many of its trigrams are posted; the texts found are candidates, and only they are
searched with the expression.  A rule without a mandatory trigram searches every text.

The scan posts the trigrams that its rules name (no other list is read).  Everything
runs as DataFrame functions: places come from the lengths of the pieces between matches.

Places are code points, the end exclusive; matches are leftmost and non-overlapping per
kind, and a match that fails the kind's test is dropped after it was made.  Expressions
are read by the JVM and by the trigram derivation: literals, classes, groups, alternatives,
greedy repeats and (?i:...).  Defined results: null and empty texts have no spans; texts of any length
are taken whole; rows that repeat an id or have a null id are judged by their own text; an
empty table stays empty.  Other columns of the documents stay as they are; one named like
the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, fresh

#: Strings that a part of an expression is held as, and alternatives of a query, at most.
MAX_STRINGS, MAX_ALTERNATIVES = 48, 64
#: Tasks over which the rows of one text are dealt when they meet their rules.
SALTS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, and the least length of ``group`` (0: whole match)."""
    kind: str
    pattern: str
    least: int = 1
    group: int = 0


_KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
#: A run of capitals or of hex digits is taken as a whole, so the least length stands in the expression.
BASE = [Rule("assign", "(" + _KEYWORDS + ''')["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)''', 6, 2),
        Rule("access", "AKIA[A-Z0-9]{16,}"),
        Rule("hex", "[0-9a-f]{24,}")]
#: Published formats of further credentials.
MORE = [Rule("pem", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
        Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
        Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 40),
        Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 20),
        Rule("maps", "AIza[A-Za-z0-9_-]+", 39),
        Rule("payment", "[rs]k_live_[A-Za-z0-9]+", 24),
        Rule("login", "://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@", 8)]
RULES = BASE + MORE

# --- trigram queries ---------------------------------------------------------
#
# A query is a set of alternatives, each a set of trigrams; ANY holds for every text.

ANY = frozenset([frozenset()])


def _least(q: frozenset) -> frozenset:
    """Without alternatives that contain another one; too many make no condition."""
    q = frozenset(a for a in q if not any(b < a for b in q))
    return q if len(q) <= MAX_ALTERNATIVES else ANY


def _both(p: frozenset, q: frozenset) -> frozenset:
    if p == ANY or q == ANY:
        return q if p == ANY else p
    return _least(frozenset(a | b for a in p for b in q)) if len(p) * len(q) <= MAX_ALTERNATIVES else min(p, q, key=len)


def _one_of(strings: frozenset) -> frozenset:
    """The text holds one of these strings."""
    return _least(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


@dataclass(frozen=True)
class _Part:
    """What a part of an expression says: all its strings (None: not known), else strings of
    which one begins and one ends each match; and a condition on the text."""
    exact: frozenset | None
    pre: frozenset = frozenset([""])
    suf: frozenset = frozenset([""])
    query: frozenset = ANY

    def open(self) -> _Part:
        """The same with the strings given up, but for their ends."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _one_of(self.exact))


_UNKNOWN, _EMPTY = _Part(None), _Part(frozenset([""]))


def _after(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MAX_STRINGS:
        return _Part(frozenset(a + b for a in x.exact for b in y.exact))
    ends, begins = x.exact or x.suf, y.exact or y.pre
    seam = _one_of(frozenset(a + b for a in ends for b in begins)) if len(ends) * len(begins) <= MAX_STRINGS else ANY
    pre, suf = x.open().pre, y.open().suf
    if x.exact is not None and len(x.exact) * len(begins) <= MAX_STRINGS:
        pre = frozenset((a + b)[:2] for a in x.exact for b in begins)
    if y.exact is not None and len(ends) * len(y.exact) <= MAX_STRINGS:
        suf = frozenset((a + b)[-2:] for a in ends for b in y.exact)
    return _Part(None, pre, suf, _both(_both(x.open().query, y.open().query), seam))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MAX_STRINGS:
        return _Part(frozenset().union(*(p.exact for p in parts)))
    parts = [p.open() for p in parts]
    queries = frozenset().union(*(p.query for p in parts))
    return _Part(None, frozenset().union(*(p.pre for p in parts)), frozenset().union(*(p.suf for p in parts)), _least(queries))


def _characters(items) -> frozenset | None:
    out = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_STRINGS:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return frozenset(out)


def _part(tree) -> _Part:
    x = _EMPTY
    for op, arg in tree:
        if op is sre.LITERAL:
            y = _Part(frozenset([chr(arg).lower()]))
        elif op is sre.IN:
            some = _characters(arg)
            y = _Part(some) if some and len(some) <= 8 else _UNKNOWN
        elif op is sre.SUBPATTERN:
            y = _part(arg[3])
        elif op is sre.BRANCH:
            y = _either([_part(b) for b in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _part(inner)
            if (low, high) == (0, 1):
                y = _either([_EMPTY, one])
            elif low:
                y = one
                for _ in range(min(low, 3) - 1):
                    y = _after(y, one)
                y = y if high == low <= 3 else _after(_after(y, _UNKNOWN), _Part(None, query=ANY, suf=one.open().suf))
            else:
                y = _UNKNOWN
        else:
            y = _EMPTY if op is sre.AT else _UNKNOWN
        x = _after(x, y)
    return x


def trigram_query(pattern: str) -> frozenset:
    """Alternatives of trigram sets, one of which any lower-cased text with a match holds."""
    return _part(sre_parser.parse(pattern)).open().query


# --- the index ---------------------------------------------------------------

def trigram_index(texts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(key, text) -> postings (gram, key): each distinct trigram of a lower-cased text, or
    those of the ``wanted`` list that it holds."""
    low = texts.select("key", F.lower("text").alias("low"))
    if wanted is None:
        chars = low.select("key", F.split("low", "").alias("c")).where("size(c) >= 3")
        grams = F.transform(F.sequence(F.lit(0), F.array_size("c") - 3), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))
        return chars.select(F.explode(F.array_distinct(grams)).alias("gram"), "key").distinct()
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted]))
    return low.select(F.explode(held).alias("gram"), "key").distinct()


def _query_table(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame | None, list[str]]:
    """A row for each (rule, alternative, trigram), and the trigrams."""
    rows = [(n, k, len(a), g) for n, r in enumerate(rules) for k, a in enumerate(sorted(trigram_query(r.pattern), key=sorted))
            for g in sorted(a)]
    return (spark.createDataFrame(rows, "rule int, alternative int, need int, gram string") if rows else None,
            sorted({r[3] for r in rows}))


def candidates(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, rules): the texts that hold every trigram of an alternative, by intersecting its
    postings; ``asked`` has a row for each trigram of the rules and is broadcast."""
    hits = postings.join(F.broadcast(asked), "gram").groupBy("key", "rule", "alternative", "need").agg(F.count("*").alias("c"))
    return hits.where("c = need").groupBy("key").agg(F.collect_set("rule").alias("rules"))


# --- verification ------------------------------------------------------------

def _running(lengths: Column) -> Column:
    """Sums of all items up to each one, in blocks, so that long lists aren't copied at every step."""
    size = 512

    def sums(xs, start):
        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")),
                           lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["all"], s["at"] + x).alias("all")))["all"]

    def total(xs):
        return F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.array_size(lengths) - 1) / size).cast("int")),
                         lambda i: F.slice(lengths, i * size + 1, F.lit(size)))
    parts = F.transform(blocks, lambda b: F.struct(b.alias("b"), total(b).alias("t")))
    starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all")),
                         lambda s, p: F.struct((s["at"] + p["t"]).alias("at"),
                                               F.array_append(s["all"], sums(p["b"], s["at"])).alias("all")))["all"]
    return F.when(F.array_size(lengths) > 0, F.flatten(starts)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans (start, order, kind, end) of a rule in a text."""
    pattern = f"({rule.pattern})"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if not rule.group else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group + 1))
    pieces = F.split(text, rule.pattern, -1)
    # pieces and matches in turn: a piece, a match, a piece ...; places are running sums of their lengths
    steps = F.zip_with(pieces, whole, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    made = F.arrays_zip(_running(steps).alias("end"), whole.alias("whole"), judged.alias("judged"))
    good = F.filter(made, lambda x: F.length(x["judged"]) >= rule.least)
    spans = F.transform(good, lambda x: F.struct((x["end"] - F.length(x["whole"])).alias("start"), F.lit(order).alias("order"),
                                                 F.lit(rule.kind).alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(none)


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with ``secrets``: the spans (start, order, kind, end) of all rules, by start, then
    the rules' order."""
    spark = docs.sparkSession
    docs = docs.drop(into)
    key, salt, found = fresh(docs, "_key", "_salt", "_found")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    asked, wanted = _query_table(spark, rules)
    free = [n for n, r in enumerate(rules) if trigram_query(r.pattern) == ANY]
    if asked is None:
        docs = docs.withColumn(found, F.lit(None).cast("array<int>"))
    else:
        scratch = Scratch(spark, "trigrams")
        index = scratch.keep(trigram_index(docs.select(F.xxhash64(body).alias("key"), body.alias("text")), wanted), "index")
        # copies of one text are dealt over SALTS tasks; written in that form, so that its size is known to the join
        some = candidates(index, asked).select(F.col("key").alias(key), F.col("rules").alias(found),
                                               F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias(salt))
        some = scratch.keep(some, "candidates")
        docs = (docs.withColumn(key, F.xxhash64(body)).withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
                .join(some, [key, salt], "left"))
    parts = []
    for n, r in enumerate(rules):
        spans = spans_of(body, r, n)
        parts.append(spans if n in free else F.when(F.array_contains(found, n), spans))
    return docs.withColumn(into, F.array_sort(F.flatten(F.array_compact(F.array(*parts))))).drop(key, salt, found)
