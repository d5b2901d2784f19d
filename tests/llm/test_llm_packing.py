from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from llm_data import awkward_rows, frame, prose
from tokenizers import Tokenizer

from tidefold.llm.bpe import Encoder, default_path
from tidefold.llm.packing import assign, capacities, cost, pack

ODD = ["", " ", "  a  b", "a\n b", "\n\n x", "don't we'll  x", "a\x1cb \x1c c", "x \x85 y", "é ü 漢字 😀 a😀b c", "x <|endoftext|> y"]


def test_ids_and_spans_equal_the_library(spark):
    reference, own = Tokenizer.from_file(default_path()), Encoder(default_path())
    pick = random.Random(1)
    texts = ODD + ["".join(pick.choices(" \n\t\r\x1c\x85ab'sé漢1.<|😀", k=pick.randint(1, 14))) for _ in range(2000)]
    for text in texts:
        said = reference.encode(text, add_special_tokens=False)
        assert own.ids(text).tolist() == said.ids
        first, last = own.spans(text)
        assert [(a, b + 1) for a, b in zip(first.tolist(), last.tolist())] == said.offsets


def check(rows, found, size):
    reference = Tokenizer.from_file(default_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    wanted = defaultdict(list)
    for i, text, *_ in rows:
        wanted[i].append(reference.encode(text or "", add_special_tokens=False).ids + [0])
    assert set(by_doc) == set(wanted)
    for i, docs in wanted.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(docs[0])
                assert np.frombuffer(bytes(r.ids), "<u4").tolist() == docs[0][at : at + r.length]
                at += r.length
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or (at < size and at & (at - 1) == 0)  # nothing is padded


def test_round_trip(spark):
    rows = awkward_rows() + [(100 + k, prose(k, 50 + 37 * k), "en", "a") for k in range(40)]
    check(rows, pack(frame(spark, rows).repartition(3)).collect(), 1024)
    check(rows, pack(frame(spark, rows), size=100).collect(), 100)


def test_assignment_balances_cost():
    pick = random.Random(5)
    lengths = [pick.randint(1, 1023) for _ in range(500)]
    pieces, n = assign(lengths, 1024)
    taken = defaultdict(int)
    for item, _, length, *_ in pieces:
        taken[item] += length
    assert [taken[i] for i in range(500)] == lengths
    assert len(pieces) < 800  # half of them fit whole, though no sequence has a gap
    assert sum(lengths) // 1024 <= n <= sum(lengths) // 1024 + 10


def brute_assign(lengths, size):
    """The rule in words: look at all sequences each time."""
    room = capacities(sum(lengths), size)
    spent, filled, pieces = [0.0] * len(room), [0] * len(room), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = [s for s in range(len(room)) if room[s] >= left] or [s for s in range(len(room)) if room[s]]
            s = min(fits, key=lambda s: (spent[s], s))
            taken = min(left, room[s])
            pieces.append((item, start, taken, s, filled[s]))
            start, left, room[s], filled[s] = start + taken, left - taken, room[s] - taken, filled[s] + taken
            spent[s] += cost(taken)
    return pieces, len(room)


def test_assignment_is_the_rule():
    pick = random.Random(6)
    draws = (lambda: pick.randint(1, 1023), lambda: min(1023, int(pick.lognormvariate(5, 1)) + 1), lambda: pick.choice([1, 2, 512, 1000]))
    for draw in draws:
        for n in (0, 1, 2, 7, 300):
            lengths = [draw() for _ in range(n)]
            assert assign(lengths, 1024) == brute_assign(lengths, 1024)
    for size in (1, 2, 3, 8, 100):
        lengths = [pick.randint(1, size) for _ in range(60)]
        assert assign(lengths, size) == brute_assign(lengths, size)


def test_empty_table(spark):
    assert pack(frame(spark, [])).count() == 0
