from __future__ import annotations

from collections import defaultdict

from llm_data import awkward_rows, frame

from tidefold.llm.linededup import MIN_SITES, remove_widespread_lines, widespread

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites, ids = defaultdict(set), defaultdict(set)
    for i, text, _, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(BLANKS):
                sites[line.strip(BLANKS)].add(site)
                ids[line.strip(BLANKS)].add(i)
    out = []
    for i, text, _, site in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        kept = []
        for line in text.split("\n"):
            key = line.strip(BLANKS)
            known = [x for x in ids[key] if x is not None] if key else []
            gone = bool(key) and len(sites[key]) >= min_sites and bool(known) and i != min(known)
            if not gone:
                kept.append(line)
        out.append((i, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return sorted(out, key=repr)


def rows():
    menu, notice, rare = "Home  About us", "© all rights", "only twice here"
    made = [(200 + k, f"{menu}\nown text {k}\n\n {notice} \nlast {k}", "en", f"s{k % 7}") for k in range(30)]
    made += [(300, f"{rare}\n{menu}", "en", "a"), (301, f"{rare}\n{menu}\n{menu}", "en", "b"), (302, menu, "en", None)]
    made += [(None, f"{menu}\nmore", "en", "q")]
    made += [(400 + k, f"edge line\nbody {k}", "en", s) for k, s in enumerate(("x", "y", None))]
    made += [(500 + k, f"short spread\nbody {k}", "en", s) for k, s in enumerate(("x", "y", "y"))]
    return awkward_rows() + made


def test_against_brute_force(spark):
    for least in (2, MIN_SITES, 6):
        found = remove_widespread_lines(frame(spark, rows()), min_sites=least)
        got = sorted(((r.doc_id, r.text, r.removed_lines) for r in found.collect()), key=repr)
        assert got == brute(rows(), least)


def test_columns_stay(spark):
    docs = frame(spark, rows())
    assert sorted(remove_widespread_lines(docs).columns) == sorted(docs.columns)


def test_exact_near_the_threshold(spark):
    """Thousands of sites: the sketches err, the lines near the threshold are counted."""
    wide = [(k, s) for k, n in ((1, 995), (2, 999), (3, 1000), (4, 1001), (5, 1500), (6, 200)) for s in range(n)]
    pairs = spark.createDataFrame(wide, "key long, site long")
    pairs = pairs.unionAll(pairs)
    assert sorted(r.key for r in widespread(pairs, 1000).collect()) == [3, 4, 5]


def test_empty_table(spark):
    assert remove_widespread_lines(frame(spark, [])).count() == 0
