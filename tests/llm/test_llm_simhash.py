from __future__ import annotations

import random

import xxhash
from llm_data import WORD, awkward_rows, frame, prose

from tidefold.llm import simhash
from tidefold.llm.components import components
from tidefold.llm.simhash import keep_first, links, near_duplicates


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rows = awkward_rows() + [(100 + k, prose(9, 300) + (" x" if k else ""), "en", "a") for k in range(2)]
    found = near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, _, _ in rows]
    roots = brute_roots(fps)
    least = {}
    for (i, *_), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    expected = [(i, format(f, "016x"), least.get(r)) for (i, *_), f, r in zip(rows, fps, roots)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_crowded_lists_lose_no_link(spark):
    """Many fingerprints around few centres: lists beyond the limit, chains of two bits, and strays."""
    pick = random.Random(3)
    fps = set()
    for _ in range(3):
        centre = pick.getrandbits(64)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in pick.sample(range(64), pick.choice((1, 1, 2, 3, 5)))))
    chain = pick.getrandbits(64)
    for step in range(12):
        chain ^= 0b11 << (2 * step)
        fps.add(chain)
    fps |= {pick.getrandbits(64) for _ in range(200)}
    fps = sorted(map(signed, fps))
    found = links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in pairs)
    assert len(pairs) < 65 * len(fps)
    roots = {r.id: r.root for r in components(found).collect()}
    expected = brute_roots(fps)
    named = {}
    for f, root in zip(fps, expected):
        assert named.setdefault(root, roots.get(f, f)) == roots.get(f, f)
    assert len(set(named.values())) == len(set(expected))
    assert simhash.LIST_LENGTH < 150


def test_keep_first(spark):
    docs = frame(spark, awkward_rows())
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 1, 2, 3 have no words; 8 (twice) and 11 are copies, the other 8 is not.
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 11 not in ids and ids.count(8) == 2
    assert {4, 5, 7, 12, 13, 14, None} <= set(ids)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0 and keep_first(frame(spark, [])).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    found = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {2: 1, 3: 1, 9: 8} | {k: 100 for k in range(101, 161)}
