from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators import compare as C
from leafmill.operators import pages as P
from leafmill.operators.ranges import every_group, page_range, parse_page_range

CASES = [
    ("3-1", 5, [2, 1, 0]), ("1,1,2", 5, [0, 1]), ("2-n", 4, [1, 2, 3]), ("2-last", 4, [1, 2, 3]), ("1，3", 3, [0, 2]), (" 1 - 3 , 5 ", 5, [0, 1, 2, 4]),
    ("", 3, [0, 1, 2]), (None, 2, [0, 1]), ("全部", 2, [0, 1]), ("ODD", 5, [0, 2, 4]), ("偶数页", 5, [1, 3]), ("even", 1, []), ("末页", 3, [2]), ("2–3；1", 3, [1, 2, 0]),
    ("0", 3, None), ("4", 3, None), ("1-9", 3, None), ("abc", 3, None), (",", 3, None), ("1", 0, None), ("99999999999", 3, None), ("3-1-2", 5, None),
]


def test_ranges(spark):
    df = spark.createDataFrame([(k, s, n) for k, (s, n, _) in enumerate(CASES)], "k int, spec string, n int")
    for r in df.select("k", parse_page_range(F.col("spec"), F.col("n")).alias("r")).collect():
        assert r.r.pages == CASES[r.k][2], CASES[r.k]
        assert (r.r.error is None) == (r.r.pages is not None)


def test_watermark_ranges_know_no_keywords(spark):
    found = spark.range(1).select(*[parse_page_range(s, 4, keywords=False)["pages"].alias(str(k)) for k, s in enumerate(("odd", "2-n", "3-2", "all", "1 - 2"))]).first()
    assert list(found) == [None, None, [2, 1], [0, 1, 2, 3], None]


def test_bad_range_fails(spark):
    with pytest.raises(Exception, match="outside the pages"):
        spark.range(1).select(page_range("9", 3)).collect()


def test_split_every(spark):
    assert spark.range(1).select(every_group(5, 2)).first()[0] == [[0, 1], [2, 3], [4]]


def test_organize_and_remove_refuse(spark):
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "doc string, page int, text string")
    plan = spark.createDataFrame([("a", 0, 5, 0.0)], "doc string, pos int, page int, rotation double")
    with pytest.raises(Exception, match="not there"):
        P.organize(pages, plan, "doc", "page").collect()
    with pytest.raises(Exception, match="every page"):
        P.remove(pages, "doc", "page", "all").collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=25))
def test_common_lines(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    assert C.common_lines(a, b) == row[-1]


def test_line_diff(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, "a  b \r\nx", "a b\nx"), (3, "same", "same"), (4, "", "x"), (5, "a\n\nb", "a\nb")], "k long, text_a string, text_b string")
    found = {r.k: (r.added, r.removed, r.same) for r in C.line_diffs(pairs, ["k"]).collect()}
    assert found == {1: (1, 1, False), 2: (0, 0, True), 3: (0, 0, True), 4: (1, 1, False), 5: (0, 1, False)}
    assert {r.k for r in C.line_diffs(pairs, ["k"], ignore_white_space=False).collect() if r.same} == {3}
