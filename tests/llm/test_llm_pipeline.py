from __future__ import annotations

from collections import Counter

import numpy as np
from llm_data import EXTRA, WORD, awkward_rows, frame, prose
from test_llm_lines import brute as brute_lines
from test_llm_packing import check
from test_llm_quality import counts
from test_llm_simhash import brute_fingerprint, brute_roots

import corpus_pipeline
from tidefold.llm.quality import STOP_WORDS


def corpus():
    rows = awkward_rows()
    rows += [(None, prose(21, 70), "en", "s1"), (None, prose(9, 200), None, None)]
    for k in range(60):
        menu = f"Home About Contact {k % 4}"
        rows.append((100 + k, f"{menu}\n{prose(k, 60 + k)}\n{prose(k + 500, 30)}", "en", f"s{k % 6}"))
    rows += [(300 + k, prose(9, 200), "en", f"s{k}") for k in range(5)]  # copies on several sites
    rows += [(400 + k, prose(k, 100) + (" dup" * (k == 1)), "en", "s1") for k in (1, 1)]
    rows += [(500, "#$% " * 50, "en", "s2"), (501, "the same line of words\n" * 40, "en", "s3")]
    return rows


def documents(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=repr)


def test_stages_one_by_one(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    quality, lines, near, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    rows = corpus()
    docs = frame(spark, rows)  # with extra columns, whose names the operators use inside

    good = quality(spark, docs, "")
    wanted = []
    for i, text, lang, source in rows:
        n, chars, symbols, dup, repeated = counts(text)
        share = sum(w.lower() in STOP_WORDS for w in WORD.findall(text or "")) / max(n, 1)
        split = [x for x in (text or "").split("\n") if WORD.search(x)]
        fails = n < 20 or 100 * repeated > 30 * n or not 2 <= chars / n <= 15 or symbols > 0.1 * n
        if not (fails or share < 0.005 or dup > 0.4 * max(len(split), 1)):
            wanted.append((i, text, lang, source))
    assert documents(good) == sorted(wanted, key=repr)

    cleaned = lines(spark, good, "")
    assert cleaned.columns == docs.columns and cleaned.count() == good.count()
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=repr) == sorted(
        ((i, t) for i, t, _ in brute_lines(wanted, 3)), key=repr
    )
    assert all(r.n_chars == len(r.text) and r.removed_lines == EXTRA[7] for r in cleaned.collect())

    single = near(spark, cleaned, "")
    before = documents(cleaned)
    roots = brute_roots([brute_fingerprint(t) for _, t, _, _ in before])
    groups = {}
    for row, root in zip(before, roots):
        groups[root] = min(groups.get(root, (True, 0)), (row[0] is None, row[0] or 0))
    kept = documents(single)
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(groups.values()) and set(kept) <= set(before)

    mix = mixing(spark, single, "")
    assert mix.columns == docs.columns
    copies = Counter(documents(mix))
    assert max(copies.values()) <= 2 and set(copies) <= set(documents(single))

    taken = [(r.doc_id, r.text) for r in mix.collect()]
    check(taken, packing(spark, mix, "").collect(), 1024)


def test_run_equals_the_stages(spark, tmp_path):
    docs = frame(spark, corpus()).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
    tokens = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "start", "doc_tokens").filter("start = 0").collect())
    assert tokens(found) == tokens(current)
    assert sum(np.frombuffer(bytes(r.ids), "<u4").size for r in found.collect()) == sum(r.length for r in current.collect())


def test_empty_table(spark):
    docs = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
