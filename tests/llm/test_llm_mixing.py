from __future__ import annotations

import math

import numpy as np
import pytest
from llm_data import WORD, awkward_rows, frame, prose

from tidefold.llm import mixing
from tidefold.llm.mixing import mix, mixed, round_cells, targets


def brute_targets(sizes):
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: (3, 1, 2)[n % 3] for n, k in enumerate(names)}
    full = set()
    while True:
        free = [k for k in names if k not in full]
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[k] for k in full)
        share = {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        above = {k for k in free if share[k] > 2 * sizes[k]}
        if not above:
            return {k: 2.0 * sizes[k] if k in full else share[k] for k in names}
        full |= above


def corpus():
    made = awkward_rows()[:11]
    for k in range(400):
        made.append((1000 + k, prose(k, 5 + (k * 37) % 150), "en", "abcdez"[(k * k) % 6] if k % 3 else "b"))
    return made


def test_targets(spark):
    for sizes in ({"a": 100, "b": 10, None: 7, "B": 50}, {"x": 5}, {"x": 0, "y": 4, "z": 1000}, {"x": 0}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in targets(table).collect()}
        assert found == pytest.approx(brute_targets(sizes) if sum(sizes.values()) else {"x": 0.0})


def test_mix(spark):
    rows = corpus()
    found = mix(frame(spark, rows)).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    wanted = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    got = sorted(((r.doc_id, r.size, r.source) for r in found), key=repr)
    assert got == sorted(((i, len(WORD.findall(t or "")), s) for i, t, _, s in rows), key=repr)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        assert np.floor(r.rate) <= r.copies <= np.ceil(r.rate)
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= max(60, 0.02 * wanted[source])


def test_rates_are_exponential_tilts(spark):
    """One multiplier for each source: log(rate) / size is the same for all its documents below the limit."""
    by_source = {}
    for r in mix(frame(spark, corpus())).collect():
        if r.size > 20 and r.rate < 2:
            by_source.setdefault(r.source, []).append(np.log(r.rate) / r.size)
    assert by_source
    for tilts in by_source.values():
        assert np.ptp(tilts) < 1e-4


def test_halving_alone_converges(spark, monkeypatch):
    cells = spark.createDataFrame([(1, 1, 10, 5), (1, 1, 300, 4), (2, 2, 7, 9)], "source_key int, x int, size long, n long").drop("x")
    wanted = spark.createDataFrame([(1, 700.0, 1250), (2, 100.0, 63)], "source_key int, target double, source_size long")
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    found = {}
    for steps in (40, 0):
        monkeypatch.setattr(mixing, "STEPS", steps)
        found[steps] = dict(map(tuple, mixing.multipliers(cells, wanted).collect()))
    words = {}
    for steps, tilt in found.items():
        rate = lambda key, size, tilt=tilt: min(2.0, math.exp(tilt[key] * size))
        words[steps] = (5 * 10 * rate(1, 10) + 4 * 300 * rate(1, 300), 9 * 7 * rate(2, 7))
    for got in words.values():
        assert abs(got[0] - 700) <= 0.7 and abs(got[1] - 100) <= 0.1


def test_reruns_agree(spark):
    docs = frame(spark, corpus())
    read = lambda d: sorted((r.doc_id or -1, r.taken, r.target) for r in mix(d).collect())
    assert read(docs) == read(docs.repartition(7))


def test_rounding_carries_over():
    size, n, rate = np.array([1000, 10, 3]), np.array([1, 200, 50]), np.array([0.4, 0.5, 0.7])
    copies = round_cells(size, n, rate)
    assert abs((copies * size).sum() - (n * rate * size).sum()) <= 3


def test_documents_of_the_mix(spark):
    docs = frame(spark, corpus())
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mix(docs).collect())


def test_empty_table(spark):
    assert mix(frame(spark, [])).count() == 0 and mixed(frame(spark, [])).count() == 0
