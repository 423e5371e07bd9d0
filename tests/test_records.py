from __future__ import annotations

from pyspark.sql import functions as F

from leafmill import catalog
from leafmill.operators import invoice as V
from leafmill.operators import optimize as O
from leafmill.operators import palette as P
from leafmill.operators import search as S
from leafmill.operators import stores as R

ROWS = "grp string, ord long, id string, mode string, ok boolean, size long, similarity double"


def candidates(spark, *rows):
    return spark.createDataFrame([("g", k, i, m, ok, s, v) for k, (i, m, ok, s, v) in enumerate(rows)], ROWS)


def test_pick(spark):
    rows = candidates(spark, ("a", "smart", True, 900, 0.97), ("b", "smart", True, 800, 0.95), ("c", "raster", True, 700, 0.70), ("d", "raster", False, 100, 0.99))
    assert [O.pick(rows, "grp", F.lit(t).cast("long"), 0.9).first().best for t in (1000, 850, 100, None)] == ["a", "b", None, "a"]
    first = O.pick(rows, "grp", F.lit(100)).first()
    assert (first.smallest, first.finest) == ("c", "a")
    ties = candidates(spark, ("x", "m", True, 9, 0.5), ("y", "m", True, 8, 0.5), ("z", "m", True, 8, 0.5 + 1e-12))
    assert O.pick(ties, "grp", F.lit(None).cast("long")).first().best == "y"
    assert O.pick_with_margin(ties, "grp", F.lit(100), 0.1).first().best == "z"
    assert O.pick_with_margin(ties, "grp", F.lit(1)).count() == 0


def test_search_stops_early(spark):
    sources = spark.createDataFrame([("a", 1000.0), ("b", 10.0)], "grp string, n double")
    steps = O.planned(sources, "grp", "n", True)
    seen = O.search(lambda df: df.withColumns({"ok": F.lit(True), "size": F.floor("estimate").cast("long"), "similarity": F.lit(1.0)}), steps, "grp", 200)
    assert {r.grp: r["count"] for r in seen.groupBy("grp").count().collect()} == {"a": 1, "b": 1}


def test_targets_and_between(spark):
    assert (O.target_bytes(2), O.target_bytes(2, "MiB")) == (2_000_000, 2_097_152)
    assert spark.range(1).select(O.between(F.lit(60.0), F.lit(70.0))).first()[0] == [62.0, 65.0, 68.0]


def test_refined(spark):
    rows = [("a", "smart", [1.0, 88.0, 82.0], 900), ("a", "smart", [0.9, 85.0, 78.0], 700), ("b", "gs", [150.0], 100), ("b", "gs", [132.0], 90), ("c", "raster", [72.0, 45.0], 900), ("d", "smart", [0.32, 56.0, 40.0], 900), ("e", "gs", [50.0], 900)]
    df = spark.createDataFrame([(*r, True) for r in rows], "grp string, mode string, params array<double>, size long, ok boolean")
    found = {}
    for r in O.refined(df, "grp", F.lit(800)).collect():
        found.setdefault(r.grp, []).append(list(r.params))
    assert {k: sorted(v) for k, v in found.items()} == {"a": [[0.925, 86.0, 79.0], [0.95, 86.0, 80.0], [0.975, 87.0, 81.0]], "b": [[162.0], [174.0]], "c": [[40.0, 40.0], [56.0, 40.0]], "d": [[0.2, 45.0, 30.0], [0.25, 50.0, 35.0]]}


def test_secrets(spark):
    nested = '{"a":{"userPw":1,"b":[{"token":2,"c":3}]},"password":4}'
    df = spark.createDataFrame([(nested,), ("junk",), (None,)], "o string")
    assert [r[0] for r in df.select(R.redacted_deep(F.col("o"))).collect()] == ['{"a": {"b": [{"c": 3}]}}', None, None]


def test_invoice(spark):
    rows = spark.createDataFrame([(1, 1, "a", 2.0, 1.5), (1, 2, " ", 9.0, 9.0), (1, 3, "b", 1.0, 0.25)], "inv long, line_no long, item string, qty double, price double")
    assert list(V.totals(rows, "inv", F.lit(10.0)).first()) == [1, 3.25, 0.33, 3.58]
    assert V.totals(rows, "inv", F.lit(500.0)).first().tax == 3.25
    assert [r.item for r in V.report(rows, "inv", F.lit(10.0)).orderBy("line_no").collect()] == ["a", "b", "小计", "税", "应收总计"]


def test_palette(spark):
    rows = spark.createDataFrame([(1, "Merge files", ["join"], "combine", "", True), (2, "Split", ["merge"], "cut", "", False), (3, "Other", ["x"], "merge too", "", False)], "id long, name string, keywords array<string>, text string, intro string, favourite boolean")
    assert [(r.id, r.score) for r in P.search(rows, "merge").collect()] == [(1, 124), (2, 85), (3, 40)]
    assert [r.id for r in P.search(rows, "merge cut").collect()] == [2]
    assert [r.id for r in P.search(rows, " ").collect()] == [1]


def test_search(spark):
    df = spark.createDataFrame([(1, "aaaa AAA"), (2, None), (3, "b.c b.c"), (4, "x" * 500)], "k long, t string")
    assert {r.k: r.hits for r in S.search(df, ["k"], "t", "aa").collect()} == {1: 3}
    assert {r.k: r.hits for r in S.search(df, ["k"], "t", "x").collect()} == {4: 200}
    assert {r.k: r.hits for r in S.search(df, ["k"], "t", "b.c").collect()} == {3: 2}
    assert [r.snippet for r in S.snippets(df, ["k"], "t", "b.c").orderBy("snippet_no").collect()] == ["b.c b.c", "b.c b.c"]
    assert S.snippets(df, ["k"], "t", "x").count() == 8


def test_subtrees(spark):
    items = spark.createDataFrame([("a/b", 1), ("a/b/c", 2), ("ab", 4)], "folder string, size long")
    folders = spark.createDataFrame([("z",), ("a",)], "folder string")
    assert sorted(map(tuple, R.subtree_stats(items, folders, "folder", "size").collect())) == [("a", 2, 3), ("a/b", 2, 3), ("a/b/c", 1, 2), ("ab", 1, 4), ("z", 0, 0)]


def test_known_steps_of_every_user(spark):
    d = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{d}/events.parquet")
    assert events.where("user_id >= 20").count() > 0
    tools = [r[0] for r in events.where("value > 90").select("event_type").distinct().collect()]
    assert catalog.QUERIES["known_steps_all"](spark, d).count() == events.where(F.col("event_type").isin(tools)).count()
