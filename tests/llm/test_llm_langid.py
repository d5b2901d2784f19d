from __future__ import annotations

import random
from collections import Counter

import numpy as np
from llm_data import awkward_rows, frame

from tidefold.llm import langid
from tidefold.llm.langid import fit, grams, identify, letters_table


def tongue(number, seed, n):
    """Words of syllables that a language prefers."""
    own = random.Random(number)
    syllables = ["".join(own.choices("abcdefghijklmnopqrstuvwxyzäéñ", k=2)) for _ in range(40)]
    pick = random.Random(seed)
    return " ".join("".join(pick.choices(syllables, k=pick.randint(1, 3))) for _ in range(n))


def corpus(languages, docs=30):
    return [
        (1000 * x + k, tongue(x, 7919 * x + k, 15 + k), f"l{x:02d}", "a") for x in range(languages) for k in range(docs)
    ]


def test_held_out_accuracy(spark):
    for languages in (4, 9):  # one byte of bits, and words of 64
        rows = corpus(languages)
        train, test = [r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0]
        model = fit(frame(spark, train + awkward_rows()[:4]))
        found = {r.doc_id: r for r in identify(frame(spark, test), model).collect()}
        right = sum(found[i].lang_pred == lang for i, _, lang, _ in test)
        assert right >= 0.95 * len(test)
        assert all(0 <= r.score <= 1 for r in found.values())


def brute(train, text):
    """Sets of n-grams instead of filters: the language whose n-grams make up most of the text."""

    def grams_of(body):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in body)
        run = " " + " ".join(letters.split()) + " "
        return [run[i : i + 4] for i in range(len(run) - 3)]

    counts = {}
    for _, body, language, _ in train:
        counts.setdefault(language, Counter()).update(grams_of(body))
    own, shares = grams_of(text), {}
    for language, n in sorted(counts.items()):
        total = sum(n.values())
        kept = {g for g, c in n.items() if c > 1 and c >= total * langid.LEAST_SHARE}
        shares[language] = sum(g in kept for g in own) / (len(own) * sum(n[g] for g in kept) / total)
    best = max(shares, key=shares.get)
    return best, shares[best] / sum(shares.values())


def test_filters_decide_as_the_sets_do(spark):
    for languages in (4, 9):
        rows = corpus(languages, docs=12)
        train, test = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
        # Texts of two languages and of words that none has.
        test += [(9000 + k, f"{tongue(0, k, 9)} {tongue(1, k, 4)} xqzw", "x", "a") for k in range(10)]
        found = {r.doc_id: r for r in identify(frame(spark, test), fit(frame(spark, train))).collect()}
        for i, text, *_ in test:
            language, score = brute(train, text)
            assert found[i].lang_pred == language and abs(found[i].score - score) < 1e-3


def test_awkward_texts(spark):
    model = fit(frame(spark, corpus(3)))
    rows = awkward_rows()
    found = identify(frame(spark, rows), model, ("doc_id", "kept")).collect()
    assert len(found) == len(rows)
    named = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert named[1] == named[2] == named[3] == ("und", 0.0)
    assert all(r.lang_pred in {"und", "l00", "l01", "l02"} for r in found)
    none = identify(frame(spark, rows), fit(frame(spark, [(1, "x", None, "a")])))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_steps_give_the_same_grams(monkeypatch):
    table, text = letters_table(), "Ein  Satz, mit Zahlen 12 3 und\n\n Ü! " * 20
    whole = np.concatenate(list(grams(text, table)))
    for step in (7, 64):
        monkeypatch.setattr(langid, "CHARS_PER_DOC_STEP", step)
        assert np.concatenate(list(grams(text, table))).tolist() == whole.tolist()


def test_correction_for_false_positives():
    model = langid.Model(["a", "b"], 0, np.zeros(1, np.uint8), np.array([0.0, 0.5]), np.ones(2))
    assert model.decide(np.array([40, 60]), 100)[0] == "a"  # 60 hits of b are 20 true ones
    assert model.decide(np.array([0, 50]), 100) == ("a", 0.0)


def test_empty_table(spark):
    assert fit(frame(spark, [])) is None
    assert identify(frame(spark, []), None).count() == 0
