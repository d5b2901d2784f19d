from __future__ import annotations

import pytest
from llm_data import WORD, awkward_rows, frame, prose

from tidefold.llm.quality import Bounds, keep_good, quality_rules


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_of_awkward_texts(spark):
    rows = awkward_rows() + [(20, "a b c d e f g h " * 5 + "#tag 5% <b>", "en", "a"), (21, "x y\n" * 40, "en", "a")]
    found = quality_rules(frame(spark, rows)).collect()
    expected = sorted(((i, *counts(t)) for i, t, _, _ in rows), key=repr)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert sorted(got, key=repr) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
        assert r.kept == (not r.failed_rules and not r.base_failed)


def test_bounds_are_included_and_compiled(spark):
    docs = frame(spark, [(1, "the " + prose(1, 19), "en", "a"), (2, "the " + prose(1, 18), "en", "a")])
    verdict = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert verdict == {1: True, 2: False}
    none = quality_rules(docs, rules={"n_words": Bounds(None, 19)}).collect()
    assert {r.doc_id: list(r.failed_rules) for r in none} == {1: ["n_words"], 2: []}
    with pytest.raises(ValueError):
        quality_rules(docs, rules={"nonsense": Bounds(0, 1)})


def test_filter_keeps_all_columns_and_clean_rows(spark):
    docs = frame(spark, awkward_rows())
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted((r.doc_id for r in quality_rules(docs).filter("kept").collect()), key=repr)
    assert 12 in ids and 1 not in ids


def test_one_projection_without_python(spark):
    plan = quality_rules(frame(spark, awkward_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    empty = frame(spark, [])
    assert quality_rules(empty).count() == 0 and keep_good(empty).count() == 0
