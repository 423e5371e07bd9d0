"""Choosing among compression candidates: ladders, estimates, neighbours, and the best under a target.

Candidates are rows (group, ord, id, mode, ok, size, similarity).  Choices are aggregations with
`max_by` and `min_by`, so any number of groups is decided at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidate parameters, best quality first: (scale, quality) and (dots an inch, quality).
SMART = [(1.0, 78), (0.9, 72), (0.8, 66), (0.7, 60), (0.6, 54), (0.5, 48), (0.4, 42)]
RASTER = [(150, 85), (120, 80), (100, 76), (80, 70), (60, 64)]
#: Fixed values of the second optimizer: (scale, colour quality, transparency quality), dots an inch, (dots an inch, quality).
SMART_FINE = [(1.00, 88, 82), (0.90, 85, 78), (0.80, 82, 75), (0.70, 80, 72), (0.62, 76, 66), (0.55, 72, 60), (0.48, 68, 54), (0.40, 62, 46), (0.32, 56, 40)]
SMART_ABOVE, SMART_BELOW = [(1.00, 92, 86), (1.00, 95, 90)], [(0.25, 50, 35), (0.20, 45, 30)]
SAMPLING = [150, 132, 116, 100, 88, 76]
RASTER_FINE = [(120, 80), (100, 78), (84, 75), (72, 70)]
INTERPOLATED = 3


def candidate_id(mode: Column, scale: Column, dpi: Column, quality: Column) -> Column:
    return F.when(mode == "smart", F.format_string("smart:%.2f:%d", scale, quality)).when(mode == "raster", F.format_string("raster:%d:%d", dpi, quality)).otherwise(F.lit("structural"))


def candidate_label(mode: Column, scale: Column, dpi: Column, quality: Column) -> Column:
    smart = F.format_string("图片重压 缩放%d%% · Q%d", F.floor(scale * 100 + 0.5), quality)
    return F.when(mode == "smart", smart).when(mode == "raster", F.format_string("栅格化 %dDPI · Q%d", dpi, quality)).otherwise(F.lit("结构无损优化"))


def estimate(mode: Column, scale: Column, dpi: Column, source: Column) -> Column:
    """The size that a candidate is expected to have."""
    return F.when(mode == "structural", source * 0.92).when(mode == "smart", source * 0.62 * scale).otherwise(source * 0.28 * F.pow(dpi / 150, F.lit(1.6)))


def ladder(spark: SparkSession, modes: tuple[str, ...] = ("structural", "smart", "raster")) -> DataFrame:
    """(ord, mode, scale, dpi, quality): the candidates in the order of their definition."""
    rows = [("structural", None, None, None)] if "structural" in modes else []
    rows += [("smart", s, None, q) for s, q in SMART if "smart" in modes]
    rows += [("raster", None, d, q) for d, q in RASTER if "raster" in modes]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, mode string, scale double, dpi int, quality int")


def planned(sources: DataFrame, group: str, size: str, with_target: bool, modes: tuple[str, ...] = ("structural", "smart", "raster")) -> DataFrame:
    """Each source's candidates with `step`: as defined, or, with a target, the smallest estimate first."""
    rows = sources.select(group, F.col(size).alias("source")).join(F.broadcast(ladder(sources.sparkSession, modes)))
    c = [F.col(x) for x in ("mode", "scale", "dpi", "quality")]
    rows = rows.withColumns({"id": candidate_id(*c), "label": candidate_label(*c), "estimate": estimate(c[0], c[1], c[2], F.col("source"))})
    order = ["estimate", "ord"] if with_target else ["ord"]
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def pick(candidates: DataFrame, group: str, target: Column, least: float = 0.0) -> DataFrame:
    """(group, best, smallest, finest): ids; `target` may be null for none.

    The best is the most similar within the target and of the least similarity; of equal ones the
    smaller, then the earlier.  Similarities count as equal to nine digits, so that being equal
    carries over from one pair to the next.  Without a similarity a candidate counts as 0 but passes.
    """
    fine = F.coalesce(F.col("ok"), F.lit(False)) & (F.col("size") > 0)
    value = F.coalesce(F.col("similarity"), F.lit(0.0))
    passes = fine & (target.isNull() | (F.col("size") <= target)) & (F.col("similarity").isNull() | (F.col("similarity") >= least))
    rows = candidates.withColumns({"_fine": fine, "_value": value, "_passes": passes})
    key = F.struct(F.round("_value", 9), -F.col("size"), -F.col("ord"))
    return rows.groupBy(group).agg(
        F.max_by(F.when(F.col("_passes"), F.col("id")), F.when(F.col("_passes"), key)).alias("best"),
        F.min_by("id", F.when(F.col("_fine"), F.struct("size", "ord"))).alias("smallest"),
        F.max_by("id", F.when(F.col("_fine"), F.struct("_value", -F.col("ord")))).alias("finest"),
    )


def pick_with_margin(candidates: DataFrame, group: str, target: Column, margin: float = 0.0, by_similarity: bool = True) -> DataFrame:
    """(group, best): within the target less a margin if any is, else within the target; the most similar, then the larger."""
    rows = candidates.where("ok").withColumn("_target", target).where(F.col("size") <= F.col("_target"))
    inner = F.col("size") <= F.col("_target") * (1 - margin)
    similarity = F.coalesce(F.col("similarity"), F.lit(0.0)) if by_similarity else F.lit(0.0)
    return rows.groupBy(group).agg(F.max_by("id", F.struct(inner, similarity, F.col("size"), -F.col("ord"))).alias("best"))


def best_by_mode(candidates: DataFrame, group: str, target: Column) -> DataFrame:
    """(group, mode, best): within the target before beyond it; then the most similar, or the larger within and the smaller beyond; then the earlier."""
    under = F.col("size") <= target
    size = F.when(under, F.col("size")).otherwise(-F.col("size"))
    known = F.col("similarity").isNotNull()
    key = F.struct(under, F.when(known, F.col("similarity")), F.when(~known, size), -F.col("ord"))
    return candidates.where("ok").groupBy(group, "mode").agg(F.max_by("id", key).alias("best"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Up to four candidates around one (mode, scale, dpi, quality): `side` 0 to 3, parameters within limits, repeats of itself dropped."""
    limit = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    smart = [F.struct(F.round(limit(F.col("scale") + d, 0.25, 1.0), 2).alias("scale"), F.lit(None).cast("int").alias("dpi"), F.col("quality").alias("quality")) for d in (-0.05, 0.05)]
    smart += [F.struct(F.col("scale").alias("scale"), F.lit(None).cast("int").alias("dpi"), limit(F.col("quality") + d, 30, 95).alias("quality")) for d in (-6, 6)]
    raster = [F.struct(F.lit(None).cast("double").alias("scale"), limit(F.col("dpi") + d, 40, 300).alias("dpi"), F.col("quality").alias("quality")) for d in (-15, 15)]
    raster += [F.struct(F.lit(None).cast("double").alias("scale"), F.col("dpi").alias("dpi"), limit(F.col("quality") + d, 40, 95).alias("quality")) for d in (-4, 4)]
    options = F.when(F.col("mode") == "smart", F.array(*smart)).when(F.col("mode") == "raster", F.array(*raster))
    keep = [c for c in rows.columns if c not in ("scale", "dpi", "quality", "id")]
    own = rows.withColumn("_own", candidate_id(F.col("mode"), F.col("scale"), F.col("dpi"), F.col("quality")))
    out = own.select(*keep, "_own", F.posexplode(options).alias("side", "p")).select(*keep, "_own", "side", "p.*")
    out = out.withColumn("id", candidate_id(F.col("mode"), F.col("scale"), F.col("dpi"), F.col("quality")))
    first = Window.partitionBy(*keep, "_own", "id").orderBy("side")
    return out.where("id <> _own").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_own")


def between(under: Column, over: Column, digits: int = 0) -> Column:
    """array<double>: evenly spaced values strictly between two parameters; half goes to the even."""
    return F.array(*[F.bround(under + (over - under) * F.lit(k / (INTERPOLATED + 1)), digits) for k in range(1, INTERPOLATED + 1)])


def sample_pages(n: Column, count: int = 5) -> Column:
    """array<int>: the first page of each of `count` equal parts."""
    k = F.least(F.lit(count), n).cast("int")
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * n / k).cast("int"))).otherwise(F.array().cast("array<int>"))


def spread_pages(n: Column, count: int = 5) -> Column:
    """array<int>: pages spread from the first to the last, each once; half goes to the even."""
    if count <= 1:
        return F.array(F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(n - 1, F.bround(i * (n - 1) / F.lit(count - 1), 0)).cast("int"))
    return F.array_sort(F.array_distinct(spread))


def kept_artifacts(candidates: DataFrame, group: str, most: int = 8) -> DataFrame:
    """The smallest candidates of each group: those whose files are kept."""
    order = Window.partitionBy(group).orderBy("size", "ord")
    return candidates.where("ok").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def target_bytes(amount: float, unit: str = "MB") -> int:
    """A target in decimal or binary megabytes."""
    return int(amount * (1_048_576 if unit == "MiB" else 1_000_000))


def search(evaluate, steps: DataFrame, group: str, target: int | None, least: float = 0.0, keep=lambda df: df.checkpoint()) -> DataFrame:
    """The candidate search of one source group by group of steps, stopping early where nothing is left to gain.

    `evaluate(DataFrame of candidates)` returns them with ok, size and similarity.  Steps run in
    order until each group's smallest result is within the target and similar enough; groups that
    are done take no part in later steps.  What has been evaluated is returned.  `keep` cuts the lineage of a step's
    results (a checkpoint in the cluster's shared folder), so that no step computes those before it again.
    """
    done = None
    last = steps.agg(F.max("step")).first()[0]
    for step in range((last if last is not None else -1) + 1):
        now = steps.where(F.col("step") == step)
        if done is not None:
            smallest = done.where("ok").groupBy(group).agg(F.min_by(F.struct("size", "similarity"), "size").alias("s"))
            reached = (F.lit(target is None) | (F.col("s.size") <= F.lit(target))) & (F.col("s.similarity").isNull() | (F.col("s.similarity") >= least))
            now = now.join(smallest.where(reached).select(group), group, "left_anti")
        found = keep(evaluate(now))
        if found.isEmpty():
            break
        done = found if done is None else done.unionByName(found)
    return done


def refined(results: DataFrame, group: str, target: Column) -> DataFrame:
    """(group, mode, params): further candidates between the best within the target and the nearest beyond it.

    `results` has numeric parameters as array<double> `params`, best first by their order.  Where all
    are within or all beyond, the modes' fixed steps lead outwards.  Candidates that were tried are left out.
    """
    rows = results.where("ok").withColumn("_under", F.col("size") <= target)
    by = rows.groupBy(group, "mode").agg(
        F.max(F.when(F.col("_under"), F.col("params"))).alias("under"), F.min(F.when(~F.col("_under"), F.col("params"))).alias("over"),
        F.min("params").alias("least"), F.max("params").alias("most"), F.collect_set("params").alias("tried"),
    )
    steps = F.array(*[F.lit(k / (INTERPOLATED + 1)) for k in range(1, INTERPOLATED + 1)])
    inner = F.transform(steps, lambda t: F.zip_with("under", "over", lambda u, o: u + (o - u) * t))
    whole = F.transform(inner, lambda p: F.when(F.col("mode") == "smart", F.transform(p, lambda x, i: F.when(i == 0, F.bround(x, 3)).otherwise(F.bround(x, 0)))).otherwise(F.transform(p, lambda x: F.bround(x, 0))))
    fixed = lambda rows_: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows_])
    moved = lambda base, steps_: F.array(*[F.array(*[F.col(base)[k] + F.lit(float(d)) for k, d in enumerate(s)]) for s in steps_])
    above = F.when(F.col("mode") == "smart", fixed(SMART_ABOVE)).when(F.col("mode") == "gs", moved("most", [(12,), (24,)])).otherwise(moved("most", [(30, 0), (60, 0)]))
    lower = F.array(*[F.array(F.col("least")[0] - d, F.greatest(F.lit(40.0), F.col("least")[1] - q)) for d, q in ((16.0, 8.0), (32.0, 14.0))])
    below = F.when(F.col("mode") == "smart", F.filter(fixed(SMART_BELOW), lambda p: p[0] < F.col("least")[0])).when(F.col("mode") == "gs", moved("least", [(-12,), (-24,)])).otherwise(lower)
    found = F.when(F.col("under").isNotNull() & F.col("over").isNotNull(), whole).when(F.col("over").isNull(), above).otherwise(below)
    limit = F.when(F.col("mode") == "gs", F.lit(400.0)).otherwise(F.lit(300.0))
    fits = lambda p: (F.col("mode") == "smart") | ((p[0] >= 40) & (p[0] <= limit))
    new = F.filter(F.array_distinct(F.array_except(found, "tried")), fits)
    return by.select(group, "mode", F.explode(new).alias("params"))
