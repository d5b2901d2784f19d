"""Quality rules: a table of thresholds, compiled into one projection.

RULES are made for languages written with blanks between words whose frequent words are in STOP_WORDS: English, French,
German and Spanish. A clean text in another language, or in a script without blanks, fails ``stop_word_share`` or
``mean_word_chars``; leave these two out of the table for such texts.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import SPACES, missing, stage, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages at hand, lower case.
STOP_WORDS = (
    *("the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "with", "as", "by", "be", "are"),
    *("de", "la", "le", "en", "et", "les", "des", "un", "du", "une", "que", "pour", "est", "qui", "dans", "par"),
    *("der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "nicht", "auf", "für", "ist", "im", "dem"),
    *("el", "las", "y", "los", "se", "del", "por", "con", "para", "no", "su", "al", "es", "lo"),
)


class Bounds(NamedTuple):
    """A document passes a rule if its measure lies between the two, both included."""

    least: float | None
    most: float | None


# The table of thresholds: the measure and its bounds.
RULES: dict[str, Bounds] = {
    "n_words": Bounds(20, None),
    "repeat_share": Bounds(None, 0.3),
    "mean_word_chars": Bounds(2.0, 15.0),
    "symbols_per_word": Bounds(None, 0.1),
    "stop_word_share": Bounds(0.005, None),
    "dup_line_share": Bounds(None, 0.4),
}
BASE = ("n_words", "repeat_share")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))




def _measures() -> dict[str, Column]:
    c = F.col
    return {
        "n_words": c("n_words"),
        "repeat_share": _share(c("n_repeat_words"), c("n_words")),
        "mean_word_chars": _share(c("word_chars"), c("n_words")),
        "symbols_per_word": _share(c("n_symbols"), c("n_words")),
        "stop_word_share": _share(c("n_stop_words"), c("n_words")),
        "dup_line_share": _share(c("n_dup_lines"), c("n_lines")),
    }


def compiled(rules: Mapping[str, Bounds]) -> dict[str, Column]:
    """A condition for each rule: true if the document fails it.

    Shares are compared as products, so that no rounding decides at a bound
    that is a whole number of hundredths.
    """
    measures = _measures()
    unknown = set(rules) - set(measures)
    if unknown:
        raise ValueError(f"no such measures: {sorted(unknown)}")
    failed = {}
    for name, (least, most) in rules.items():
        below = F.lit(False) if least is None else measures[name] < F.lit(least)
        above = F.lit(False) if most is None else measures[name] > F.lit(most)
        if name == "repeat_share" and most is not None:
            above = 100 * F.col("n_repeat_words") > F.lit(100 * most) * F.col("n_words")
        failed[name] = below | above
    return failed


def _counted(df: DataFrame) -> DataFrame:
    """Add the counts to a table with a column ``body``."""
    body = F.coalesce(F.col("body"), F.lit(""))
    df = stage(
        df,
        words=words_of(F.col("body")),
        lines=F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0),
    )
    df = stage(
        df,
        windows=F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only a text in which some window occurs twice has its windows sorted.
    paired = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = stage(df, paired=F.when(repeats, paired).otherwise(none))
    same = lambda x, k: F.coalesce(F.get(F.col("paired"), k)["h"] == x["h"], F.lit(False))
    found = F.filter("paired", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = stage(df, at=F.array_sort(F.transform(found, lambda x: x["i"])))
    # A window adds those words that the one before it has not covered.
    covered = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), p - F.coalesce(F.get(F.col("at"), k - 1), p - WINDOW)))
    return stage(
        df,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.regexp_replace(body, SPACES, "")).cast("long"),
        n_symbols=(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_stop_words=F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    )


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def quality_rules(
    docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", rules: Mapping[str, Bounds] = RULES
) -> DataFrame:
    """Judge every document by the table of thresholds, in one projection without user functions.

    Returns ``keys`` and: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words in
    windows of eight words that occur twice or more), ``base_failed`` (the first two rules), ``kept`` and
    ``failed_rules``, the names of the rules that the document fails.

    * NULL, empty or blank text: all counts are 0, the document fails ``n_words``.
    * NULL keys are kept.  Repeated rows are judged one by one, each gives a row.
    * A text of fewer than eight words has no window, so no repeated words.
    * Very long texts are judged whole; the work grows as n log n with their words.
    * Other columns of the table are ignored, whatever their names.  An empty table gives no rows.
    """
    missing(docs, text, *keys)
    df = docs.select(F.struct(*keys).alias("row"), F.col(text).alias("body"))
    failed = compiled(rules)
    verdict = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()]), lambda x: x.isNotNull())
    base = compiled({n: RULES[n] for n in BASE})
    df = _counted(df).withColumns(
        {"base_failed": base["n_words"] | base["repeat_share"], "failed_rules": verdict.cast("array<string>")}
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return df.select("row.*", *OUTPUTS)


def keep_good(docs: DataFrame, text: str = "text", rules: Mapping[str, Bounds] = RULES) -> DataFrame:
    """The documents, with all their columns, that no rule rejects; see ``quality_rules`` for NULLs and other cases.

    Repeated rows stay or go together. An empty table stays empty.
    """
    missing(docs, text)
    failed = compiled({n: RULES[n] for n in BASE} | dict(rules))
    bad = F.lit(False)
    for condition in failed.values():
        bad = bad | condition
    df = _counted(docs.select(F.struct("*").alias("row"), F.col(text).alias("body")))
    return df.filter(~bad).select("row.*")
