"""Secrets in texts, found through an inverted index of trigrams.

From each rule's regular expression a Boolean query of trigrams is derived: every match holds all trigrams of at least
one of its alternatives. Postings say which documents hold which of these trigrams; the postings that a rule asks for
are intersected document by document, and only the documents that remain are searched with the expression. A rule from
which no trigram can be derived, as a run of hexadecimal digits, searches all documents.

Columns of Spark only; no user functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import missing, stage
from tidefold.operators.sizing import small_side


class Rule(NamedTuple):
    """Matches of ``pattern``, leftmost first and not overlapping; those whose ``group`` has fewer than ``least``
    characters are dropped after the search, so they still cover what they matched."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# A run of 24 hexadecimal digits or more is the same as a run of any length of which shorter ones are dropped.
RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[A-Za-z0-9._%-]{6,}@"),
)
BASE = ("assign", "access", "hex")

# Bounds of a derived query: strings that a part of an expression is spelled out to, and alternatives.
SPELLED, ALTERNATIVES = 32, 64
# Matches of which the places are summed up at a time.
BLOCK = 64

# Alternatives, each a set of trigrams that a match then holds all of. One empty alternative says nothing.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES:  # either of them alone is true as well
        return max(a, b, key=lambda q: min(map(len, q)))
    return _least(frozenset(x | y for x in a for y in b))


def _spelled(strings: set[str]) -> Query:
    """The trigrams of the strings, ASCII letters in lower case, as the index has them."""
    return _least(frozenset(frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _part(op: Any, arg: Any) -> tuple[set[str] | None, Query]:
    """The strings that a part of an expression stands for, if they are few, and the query of any match."""
    name = str(op)
    if name == "LITERAL" and arg < 128:
        return {chr(arg)}, ANYTHING
    if name == "IN" and len(arg) <= 5 and all(str(o) == "LITERAL" and a < 128 for o, a in arg):
        return {chr(a) for _, a in arg}, ANYTHING
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        found = [_sequence(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        query = _least(frozenset().union(*(q for _, q in found)))
        return strings, query if len(query) <= ALTERNATIVES else ANYTHING
    if name == "MAX_REPEAT":
        least, most, inner = arg
        strings, query = _sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return {"", *strings}, ANYTHING
        return None, query if least else ANYTHING
    return None, ANYTHING


def _sequence(parts: Any) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ANYTHING, True
    for op, arg in parts:
        strings, own = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= SPELLED:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _both(query, _spelled(run)), False
        run = strings if strings is not None else {""}
        if strings is None:
            query = _both(query, own)
    query = _both(query, _spelled(run))
    return (run if whole else None), query


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression: one of its alternatives holds for every text with a match."""
    return _sequence(re._parser.parse(pattern))[1]  # the standard library's own reading of the expression


def trigrams(queries: Sequence[Query]) -> list[str]:
    return sorted({g for q in queries for a in q for g in a})


def _keyed(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """A document is named by its keys and a hash of its text; two texts of one name share candidates, no results."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct(*keys).alias("row"), F.xxhash64(*keys, body).alias("mark"), body.alias("body"))


def trigram_index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """Postings ``gram`` (its number in ``grams``) and ``mark`` of the trigrams that rules ask for.

    ``docs`` has ``mark`` and ``body``. Texts are indexed in lower case, so one index serves rules of either case.
    """
    lowered = stage(docs.select("mark", "body"), low=F.lower("body"))
    asked = F.array(*[F.struct(F.lit(n).alias("gram"), F.lit(g).alias("held")) for n, g in enumerate(grams)])
    held = F.filter(asked, lambda g: F.contains(F.col("low"), g["held"]))
    return lowered.select("mark", F.explode(F.transform(held, lambda g: g["gram"])).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query], grams: Sequence[str]) -> DataFrame:
    """``mark`` and ``rules``: the rules whose query the postings of a document satisfy.

    A document's postings meet as bits of a few numbers, which every task combines before the shuffle.
    """
    number = {g: n for n, g in enumerate(grams)}
    words = range(-(-len(grams) // 63))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % 63)
    none = F.lit(0).cast("long")
    bits = [F.bit_or(F.when(F.floor(F.col("gram") / 63) == w, bit).otherwise(none)).alias(f"bits{w}") for w in words]
    met = index.groupBy("mark").agg(*bits)

    def all_of(wanted: frozenset[str]) -> Column:
        masks = [sum(1 << number[g] % 63 for g in wanted if number[g] // 63 == w) for w in words]
        held = [F.col(f"bits{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in zip(words, masks, strict=True) if m]
        return reduce(lambda a, b: a & b, held)

    holds = {kind: reduce(lambda a, b: a | b, [all_of(a) for a in sorted(q, key=sorted)]) for kind, q in queries.items()}
    rules = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]), lambda x: x.isNotNull())
    return met.select("mark", rules.alias("rules")).filter(F.size("rules") > 0)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _found(df: DataFrame, rules: Sequence[Rule], wanted: dict[str, Column]) -> DataFrame:
    """Add ``at_<kind>``: start, end and size of the measured group for every match of each rule in ``body``.

    Between the matches lie the parts into which they split the text, so the lengths of both give the places. They are
    summed up in blocks, which keeps a text with many matches from costing their square.
    """
    parts = [_place_columns(r, wanted[r.kind]) for r in rules]
    for step in zip(*parts, strict=True):
        df = stage(df, **{name: column for columns in step for name, column in columns.items()})
    return df


def _place_columns(rule: Rule, wanted: Column) -> list[dict[str, Column]]:
    """The columns of each step, every one over those of the step before."""
    k, body = rule.kind, F.col("body")
    own = lambda name: F.col(f"{name}_{k}")
    lengths = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    some = wanted & body.rlike(rule.pattern)  # a text without a match is not split
    pattern = F.lit(rule.pattern)
    found = {
        f"size_{k}": F.when(some, lengths(F.regexp_extract_all(body, pattern, F.lit(0)))),
        f"own_{k}": F.when(some, lengths(F.regexp_extract_all(body, pattern, F.lit(rule.group)))),
        f"gap_{k}": F.when(some, lengths(F.split(body, rule.pattern, -1))),
    }
    steps = {f"steps_{k}": F.transform(own("size"), lambda n, i: n + F.get(own("gap"), i))}
    starts = F.sequence(F.lit(1), F.size(own("steps")), F.lit(BLOCK))
    blocks = {f"blocks_{k}": F.when(F.size(own("steps")) > 0, F.transform(starts, lambda b: F.slice(own("steps"), b, BLOCK)))}
    sums = {f"sums_{k}": F.transform(own("blocks"), _total)}
    before = {f"before_{k}": F.transform(own("sums"), lambda x, b: _total(F.slice(own("sums"), 1, b)))}

    def ends_of(block: Column, b: Column) -> Column:
        return F.transform(block, lambda x, i: F.get(own("before"), b) + _total(F.slice(block, 1, i + 1)))

    ends = {f"ends_{k}": F.flatten(F.transform(own("blocks"), ends_of))}
    place = lambda e, i: F.struct(
        (e - F.get(own("size"), i)).alias("start"), e.alias("end"), F.get(own("own"), i).alias("own")
    )
    return [found, steps, blocks, sums, before, ends, {f"at_{k}": F.transform(own("ends"), place)}]


def _spans(number: int, rule: Rule) -> Column:
    long_enough = F.filter(F.col(f"at_{rule.kind}"), lambda s: s["own"] >= rule.least)
    as_span = lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("n"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")
    )
    return F.transform(long_enough, as_span)


def find_secrets(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """The secrets of every document: ``keys`` and ``spans``, an array of ``kind``, ``start`` and ``end``.

    Places count code points, the end excluded. Spans are ordered by start, then by the order of the rules; spans of
    different rules may overlap.

    The postings are as many as the rules' trigrams and the documents that hold them. Candidates are sent to all tasks
    only if they are measured to be small; otherwise documents and candidates are shuffled once, by document.

    * NULL, empty and blank texts have no spans. Every row is returned, repeated rows as often as they occur.
    * NULL keys are kept. Rows of equal keys and text share a search in the index, each is verified itself.
    * Very long texts are indexed and searched whole.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(docs, text, *keys)
    named = _keyed(docs, keys, text)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANYTHING}
    found = named.withColumn("rules", F.lit(None).cast("array<string>"))
    if queries:
        grams = trigrams(list(queries.values()))
        chosen = small_side(candidates(trigram_index(named, grams), queries, grams))
        found = named.join(chosen, "mark", "left")
    asked = lambda k: F.coalesce(F.array_contains("rules", k), F.lit(False))
    wanted = {r.kind: asked(r.kind) if r.kind in queries else F.lit(True) for r in rules}
    found = _found(found.select("row", "body", "rules"), rules, wanted)
    spans = [_spans(n, r) for n, r in enumerate(rules)]
    none = F.array().cast("array<struct<start:bigint,n:int,end:bigint,kind:string>>")
    ordered = F.array_sort(F.concat(*[F.coalesce(s, none) for s in spans]))
    named_spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("row.*", named_spans.alias("spans"))
