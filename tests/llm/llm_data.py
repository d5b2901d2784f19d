"""Small tables with every awkward case, and plain Python versions of shared notions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, words long, row long, kept boolean, copies long,"
    " mark long, size long, key long, removed_lines long, hashes string, fp long, root long, body string"
)
EXTRA = (1, 2, True, 3, 4, 5, 6, 7, "x", 8, 9, "y")


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in", *("".join(pick.choices("abcdefghijklm", k=5)) for _ in range(400))]
    return " ".join(pick.choices(vocabulary, k=n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source): NULLs, empty, blank and long texts, ties and repeated rows."""
    base = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, "b"), (4, "one", "en", None),
        (5, "two words", "de", "b"), (None, prose(1, 40), "en", "a"), (7, prose(2, 40), None, None),
        (8, prose(3, 60), "en", "c"), (8, prose(3, 60), "en", "c"), (8, prose(4, 60), "fr", "c"),
        (11, prose(3, 60).upper().replace(" ", "\t"), "en", "d"), (12, prose(5, 30_000), "en", "a"),
        (13, "\n".join([prose(6, 12)] * 5), "en", "b"), (14, "é漢 😀 " * 30, "fr", "d"),
    ]
    return base


def frame(spark, rows):
    """A table of documents with columns whose names clash with those that the operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DDL)
