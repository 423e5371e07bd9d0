"""Line differences as hunks, against a brute-force longest common subsequence."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import compare as C

LINES = st.lists(st.sampled_from("a b c d".split()), max_size=9)


def common(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(LINES, LINES)
def test_hunks_are_a_shortest_edit(a, b):
    hunks = C.line_hunks(a, b)
    assert [x for kind, held in hunks if kind != "add" for x in held] == a
    assert [x for kind, held in hunks if kind != "del" for x in held] == b
    assert sum(len(held) for kind, held in hunks if kind == "same") == common(a, b) == C.common_lines(a, b)
    assert all(held for _, held in hunks) and all(x[0] != y[0] for x, y in zip(hunks, hunks[1:]))
    assert not any((x[0], y[0]) == ("add", "del") for x, y in zip(hunks, hunks[1:]))


def test_line_diff(spark):
    rows = [(1, "a\nb", "a\nc"), (2, "x \r\n  y\n", "x\ny\n"), (3, "same\n\n", "same\n\n"), (4, "", ""), (5, "", "n"), (6, "only\nold", ""), (7, "k\tl", "k l")]
    df = spark.createDataFrame(rows, "id long, text_a string, text_b string")
    got: dict = {}
    for r in sorted(C.line_diff(df, ["id"]).collect(), key=lambda r: (r.id, r.hunk_no)):
        assert r["count"] == len(r.lines)
        got.setdefault(r.id, []).append((r.type, r.lines))
    assert got == {1: [("same", ["a"]), ("del", ["b"]), ("add", ["c"])], 2: [("same", ["x", "y"])], 3: [("same", ["same", ""])], 5: [("add", ["n"])], 6: [("del", ["only", "old"])], 7: [("same", ["k l"])]}
    exact = C.line_diff(df.where("id = 7"), ["id"], ignore_white_space=False).collect()
    assert sorted(r.type for r in exact) == ["add", "del"]
