"""Secret scanning over a trigram index, with DataFrame functions only.

A Boolean query over trigrams is derived from each rule's regular expression: what every match must contain.
The queries' trigrams are looked up in every text, giving the postings (trigram, document) of the index, a written
table; a rule's postings are intersected and united by one aggregation a document, and its regular expression is run
on the documents that remain. A rule without a mandatory trigram runs on every text. Candidates meet their texts
by a join, from which a bitmap of fixed size keeps nearly all other texts; these pass without a shuffle.

Matching and positions: ``split`` gives the text between a pattern's leftmost non-overlapping matches, and
``regexp_extract_all`` the matches; positions are running sums of their lengths, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

try:
    import re._parser as sre_parse
except ImportError:  # named so before Python 3.11
    import sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class Rule:
    """A match is dropped, after matching, if its ``group`` has fewer than ``least`` characters. ``base``: counted and digested."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules first, in the order in which they are listed. (A run of 24 or more is what's left of all runs.)
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

# Boolean queries: True (no demand), ("and", parts), ("or", parts), or a trigram. An expression's facts are
# (exact, prefix, suffix, query): the set of all its strings if small, else sets of what they begin and end with.
_MOST = 24
#: Trigrams that a conjunction keeps; fewer are demanded, so nothing is lost.
_DEMANDS = 4


def _all(*parts):
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(*parts):
    if any(p is True for p in parts):
        return True
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else [p])}
    demands = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
    flat = {q for q in flat if not any(d < demands[q] for d in demands.values())}  # what demands more than another adds nothing
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _slim(query):
    if not isinstance(query, tuple):
        return query
    parts = [_slim(q) for q in sorted(query[1], key=str)]
    if query[0] == "or":
        return _any(*parts)
    plain = [q for q in parts if isinstance(q, str)]
    return _all(*[q for q in parts if not isinstance(q, str)], *plain[:: max(1, -(-len(plain) // _DEMANDS))])


def _of_string(s: str):
    return _all(*(s[i : i + 3] for i in range(len(s) - 2)))


def _of_strings(strings):
    return _any(*(_of_string(s) for s in strings)) if strings else True


def _shut(facts):
    """Facts whose exact set is given up for its ends and its query."""
    exact, prefix, suffix, query = facts
    if exact is None:
        return facts
    return None, {s[:2] for s in exact}, {s[-2:] for s in exact}, _all(query, _of_strings(exact))


def _then(a, b):
    if a[0] is not None and b[0] is not None and len(a[0]) * len(b[0]) <= _MOST:
        return {x + y for x in a[0] for y in b[0]}, set(), set(), _all(a[3], b[3])
    over = True
    left, right = (a[0] if a[0] is not None else a[2]), (b[0] if b[0] is not None else b[1])
    if left and right and len(left) * len(right) <= _MOST * 4:
        over = _of_strings({x[-2:] + y[:2] for x in left for y in right})
    prefix = {x + y for x in a[0] for y in right} if a[0] is not None and len(a[0]) * max(1, len(right)) <= _MOST else None
    suffix = {x + y for x in left for y in b[0]} if b[0] is not None and len(b[0]) * max(1, len(left)) <= _MOST else None
    c, d = _shut(a), _shut(b)
    return None, {p[:2] for p in prefix} if prefix else c[1], {s[-2:] for s in suffix} if suffix else d[2], _all(c[3], d[3], over)


_NOTHING = ({""}, set(), set(), True)
_ANYTHING = (None, {""}, {""}, True)


def _facts(parsed):
    out = _NOTHING
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            one = ({chr(arg).lower()}, set(), set(), True)
        elif name == "IN":
            chars = set()
            for o, v in arg:
                chars |= {chr(v).lower()} if str(o) == "LITERAL" else {chr(c).lower() for c in range(v[0], v[1] + 1)} if str(o) == "RANGE" and v[1] - v[0] < _MOST else set(map(str, range(99)))
            one = (chars, set(), set(), True) if 0 < len(chars) <= 6 else _ANYTHING
        elif name == "SUBPATTERN":
            one = _facts(arg[-1])
        elif name == "BRANCH":
            parts = [_facts(p) for p in arg[1]]
            exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            if exact is not None and len(exact) <= _MOST:
                one = (exact, set(), set(), _any(*(p[3] for p in parts)))
            else:
                parts = [_shut(p) for p in parts]
                one = (None, set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts)), _any(*(p[3] for p in parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            part = _facts(inner)
            if (least, most) == (0, 1) and part[0] is not None:
                one = (part[0] | {""}, set(), set(), True)
            elif least == 0:
                one = _ANYTHING
            else:
                one = part
                for _ in range(min(least, 4) - 1):
                    one = _then(one, part)
                if least != most or least > 4:
                    one = _then(one, _ANYTHING)
        elif name == "AT":
            one = _NOTHING
        else:
            one = _ANYTHING
        out = _then(out, one)
    return out


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every text with a match of ``pattern`` satisfies; True if there's none."""
    return _slim(_shut(_facts(sre_parse.parse(pattern)))[3])


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query, postings: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(postings, query)
    parts = [_holds(q, postings) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


#: Pieces of a text whose positions are summed in one go, so that a text of many matches takes linear time.
CHUNK = 64
_SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that's computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, order, kind, stop>> of the rule's matches that are kept."""
    rank = next(i for i, r in enumerate(RULES) if r.kind == rule.kind) if rule in RULES else len(RULES)
    hits, parts = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part"))
    sizes = F.transform(pieces, lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), F.length(x["part"]).alias("part")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        stop = start + x["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(x["hit"].isNotNull() & (x["part"] >= rule.least), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def total(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + F.coalesce(x["hit"], F.lit(0)))

    def begins(chunks: Column) -> Column:
        zero = F.expr("named_struct('at', 0L, 'all', cast(array() as array<bigint>))")
        return F.aggregate(F.transform(chunks, total), zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    def placed(x: Column) -> Column:
        return F.aggregate(x["chunk"], F.struct(x["begin"].alias("at"), F.expr(_NONE).alias("spans")), step)["spans"]

    def chunked(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda i: F.slice(p, i * CHUNK + 1, F.lit(CHUNK)))

    found = _let(_let(sizes, chunked), lambda chunks: F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), begins(chunks).alias("begin")), placed)))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr(_NONE))


#: Bits of the bitmap that tells candidates' rows; however many there are, it has this size.
BITS = 1 << 23


def postings(base: DataFrame, grams: list[str]) -> DataFrame:
    """base (doc_id, row, text) -> gram, doc_id, row: the texts in which each trigram stands, in either case."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return base.select("doc_id", "row", low.alias("low")).select(F.explode(found).alias("gram"), "doc_id", "row")


def candidates(index: DataFrame, queries: dict) -> DataFrame:
    """index (gram, doc_id, row) -> c_id, c_row, kinds: the rules whose query the texts satisfy; those without any are left out."""
    lists = index.groupBy("doc_id", "row").agg(F.collect_set("gram").alias("grams"))
    named = F.filter(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(kind)) for kind, q in queries.items()]), lambda x: x.isNotNull())
    return lists.select(F.col("doc_id").alias("c_id"), F.col("row").alias("c_row"), named.alias("kinds")).where(F.size("kinds") > 0)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text, spans array<struct<start, rank, kind, stop>>, by start and then in the rules' order; one row per input row.

    start and stop count code points, stop exclusive. A null text is empty and has no spans. Rows that repeat a doc_id are
    told apart by their text; equal rows have equal spans. ``carry`` names one more column to return; others are ignored.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    demanding = {k: q for k, q in queries.items() if q is not True}
    more = [carry] if carry else []
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("row", F.xxhash64("text"))
    kinds = F.expr("cast(array() as array<string>)")
    if demanding:
        index = stash(postings(base, sorted(set().union(*map(trigrams, demanding.values())))))
        wanted = stash(candidates(index, demanding))
        place = lambda i, r: F.pmod(F.xxhash64(i, r), F.lit(BITS))
        bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
        words = wanted.select(place(F.col("c_id"), F.col("c_row")).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
        # a table of BITS / 64 rows at most
        told = base.withColumn("at", place(F.col("doc_id"), F.col("row"))).join(F.broadcast(words), F.expr("at div 64") == F.col("word"), "left")
        told = told.withColumn("may", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
        met = told.where("may").join(wanted, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row")), "left")
        base = met.select("doc_id", "text", *more, F.coalesce("kinds", kinds).alias("kinds")).union(told.where(~F.col("may")).select("doc_id", "text", *more, kinds.alias("kinds")))
    else:
        base = base.withColumn("kinds", kinds)
    found = [_spans(F.col("text"), r) if queries[r.kind] is True else F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r)) for r in rules]
    names = [f"s{i}" for i in range(len(rules))]
    each = base.select("doc_id", "text", *more, *[c.alias(n) for c, n in zip(found, names, strict=True)])
    return each.select("doc_id", "text", *more, F.array_sort(F.flatten(F.filter(F.array(*names), lambda x: x.isNotNull()))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:stop of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that meet or overlap become one."""
    zero = F.expr("named_struct('at', 0L, 'out', '')")

    def step(acc, x):
        # a span inside what was cut already only moves the end
        gap = x["start"] - acc["at"]
        more = F.when((gap > 0) | (acc["at"] == 0), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(gap, F.lit(0)).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), more.alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def base_only(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin([r.kind for r in rules if r.base]))


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
