from __future__ import annotations

from tidefold.llm.chat import conversations, format_pairs, weakened

TURNS = "conv_id long, turn long, role string, text string, pair_id long, chosen string, a string, common int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], TURNS)


def rendered(turn):
    return f"<|im_start|>{turn[0] or ''}\n{turn[1] or ''}<|im_end|>\n"


def brute(chosen, rejected):
    common = 0
    while common < min(len(chosen), len(rejected)) and chosen[common] == rejected[common]:
        common += 1
    mask = []
    for rest in (chosen[common:], rejected[common:]):
        mask.append([
            x for role, text in rest
            for x in ((len(f"<|im_start|>{role or ''}\n"), False), (len(f"{text or ''}<|im_end|>\n"), role == "assistant"))
        ])
    text = lambda part: "".join(map(rendered, part))
    return common, text(chosen[:common]), text(chosen[common:]), text(rejected[common:]), *mask


PAIRS = [
    (1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]),
    (2, [("user", "q")], [("user", "q"), ("assistant", "b")]),
    (3, [("user", "q"), ("assistant", "é😀")], [("user", "q"), ("assistant", "é😀")]),
    (4, [("user", "x")], [("user", "y")]),
    (5, None, [("user", "y")]),
    (6, [], []),
    (7, [(None, "t"), ("user", None)], [(None, "t"), ("user", "")]),
    (None, [("assistant", "z" * 50_000)], [("assistant", "z" * 49_999)]),
    (1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]),
]


def test_pairs(spark):
    kind = "array<struct<role:string,text:string>>"
    ddl = f"pair_id long, chosen {kind}, rejected {kind}, prompt string, n int, same int, a string, x string"
    found = format_pairs(spark.createDataFrame([(*p, "p", 1, 2, "c", "d") for p in PAIRS], ddl)).collect()
    got = [
        (r.pair_id, r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask])
        for r in found
    ]
    expected = [(i, *brute(a or [], b or [])) for i, a, b in PAIRS]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for r in found:
        assert sum(s.chars for s in r.chosen_mask) == len(r.chosen)


def test_conversations_and_weakened(spark):
    rows = [
        (1, 1, "assistant", "first"), (1, 0, "user", "q"), (1, 3, "assistant", "second"), (1, 2, "user", "r"),
        (2, 0, "user", "only"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"),
        (None, None, None, None), (4, 0, "user", "q"), (4, 1, "assistant", None), (4, 2, "user", "bye"),
    ]
    found = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in weakened(conversations(turns(spark, rows))).collect()}
    one = [("user", "q"), ("assistant", "first"), ("user", "r"), ("assistant", "second")]
    assert found[1] == (one, [*one[:3], ("assistant", "first")])
    assert found[2] == ([("user", "only")],) * 2
    assert found[3] == ([("user", "q"), ("assistant", "a"), ("assistant", "a")],) * 2
    assert found[4][1] == [("user", "q"), ("assistant", ""), ("user", "bye")]
    assert found[None] == ([(None, None)],) * 2


def test_empty_table(spark):
    assert format_pairs(weakened(conversations(turns(spark, [])))).count() == 0
