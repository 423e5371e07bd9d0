"""Documents as ordered pages: extract, remove, merge, split, organize and number.

A paged document is rows (doc, page_no 0-based, ...).  Order is always a column, `pos`; nothing
depends on the order in which rows arrive.  Page lists come from `operators.ranges`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranges import every_group, page_range, range_groups


def page_counts(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, n): pages are numbered without gaps, so the last number tells."""
    return pages.groupBy(doc).agg((F.max(page) + 1).cast("int").alias("n"))


def selection(pages: DataFrame, doc: str, page: str, spec: str) -> DataFrame:
    """(doc, n_selected, pos, page): the pages of a range in the order written."""
    listed = page_counts(pages, doc, page).select(doc, page_range(spec, F.col("n")).alias("listed"))
    return listed.select(doc, F.size("listed").alias("n_selected"), F.posexplode("listed").alias("pos", page))


def _with_pages(chosen: DataFrame, pages: DataFrame, doc: str, page: str, how: str = "inner") -> DataFrame:
    pages = pages.withColumn(page, F.col(page).cast("int"))
    return chosen.join(pages, [doc, page], how)


def extract(pages: DataFrame, doc: str, page: str, spec: str) -> DataFrame:
    """The pages of a range, in the order written, with their `pos`."""
    return _with_pages(selection(pages, doc, page, spec).drop("n_selected"), pages, doc, page)


def remove(pages: DataFrame, doc: str, page: str, spec: str) -> DataFrame:
    """All pages but those of a range, in their own order; a document that would lose all pages is an error."""
    n, listed = F.col("n"), page_range(spec, F.col("n"))
    left = F.when(F.size(listed) < n, listed).otherwise(F.raise_error(F.lit("cannot remove every page")).cast("array<int>"))
    gone = page_counts(pages, doc, page).select(doc, F.explode(left).alias(page))
    kept = pages.withColumn(page, F.col(page).cast("int")).join(gone, [doc, page], "left_anti")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1)


def merge(plan: DataFrame, pages: DataFrame, doc: str, page: str, job: str = "job") -> DataFrame:
    """(job, pos, item, doc, page, ...): the ranges of a job's inputs one after another, repeats allowed.

    The plan is rows (job, item, doc, spec); any number of jobs run side by side, each numbered on its own.
    """
    counts = page_counts(pages, doc, page)
    listed = plan.join(counts, doc).select(job, "item", doc, F.posexplode(page_range(F.col("spec"), F.col("n"))).alias("at", page))
    order = Window.partitionBy(job).orderBy("item", "at")
    return _with_pages(listed.withColumn("pos", F.row_number().over(order) - 1).drop("at"), pages, doc, page)


def merge_within(pages: DataFrame, doc: str, page: str, specs: list[str]) -> DataFrame:
    """Each document's ranges one after another, repeats allowed: (doc, item, pos, page) with `pos` from 0."""
    counts = page_counts(pages, doc, page)
    items = F.array(*[page_range(s, F.col("n")) for s in specs])
    listed = counts.select(doc, F.posexplode(items).alias("item", "listed")).select(doc, "item", F.posexplode("listed").alias("at", page))
    order = Window.partitionBy(doc).orderBy("item", "at")
    return _with_pages(listed.withColumn("pos", F.row_number().over(order) - 1).drop("at"), pages, doc, page)


def _labelled(groups: DataFrame, doc: str, page: str) -> DataFrame:
    first, last = F.get("listed", F.lit(0)) + 1, F.element_at("listed", -1) + 1
    label = F.when(F.size("listed") == 1, F.format_string("第%d页", first)).otherwise(F.format_string("第%d-%d页", first, last))
    return groups.select(doc, "part", label.alias("label"), F.posexplode("listed").alias("pos", page))


def split_every(pages: DataFrame, doc: str, page: str, size: int) -> DataFrame:
    """(doc, part, label, pos, page, ...): consecutive parts of `size` pages."""
    groups = page_counts(pages, doc, page).select(doc, F.posexplode(every_group(F.col("n"), size)).alias("part", "listed"))
    return _with_pages(_labelled(groups, doc, page), pages, doc, page)


def split_each(pages: DataFrame, doc: str, page: str) -> DataFrame:
    return split_every(pages, doc, page, 1)


def split_ranges(pages: DataFrame, doc: str, page: str, specs: list[str]) -> DataFrame:
    """One part for each range; parts may overlap or leave pages out."""
    groups = page_counts(pages, doc, page).select(doc, F.posexplode(range_groups(specs, F.col("n"))).alias("part", "listed"))
    return _with_pages(_labelled(groups, doc, page), pages, doc, page)


def organize(pages: DataFrame, plan: DataFrame, doc: str, page: str) -> DataFrame:
    """A plan (doc, pos, page or null for a blank, rotation) over pages: any order, repeats, blanks.

    Rotations snap to quarter turns.  A page that the document lacks is an error.
    """
    plan = plan.withColumn(page, F.col(page).cast("int"))
    known = pages.withColumn(page, F.col(page).cast("int")).withColumn("_known", F.lit(True))
    joined = plan.join(known, [doc, page], "left")
    ok = F.col(page).isNull() | F.col("_known")
    blank = F.when(F.coalesce(ok, F.lit(False)), F.col(page).isNull()).otherwise(F.raise_error(F.lit("the plan names a page that is not there")).cast("boolean"))
    turn = F.pmod(F.floor(F.col("rotation") / 90 + F.lit(0.5)) * 90, F.lit(360)).cast("int")
    return joined.withColumn("blank", blank).withColumn("rotation", turn).drop("_known")


def number(pages: DataFrame, doc: str, page: str, spec: str = "all", start: int = 1, template: str = "{n} / {N}") -> DataFrame:
    """(doc, pos, page, label): `{n}` counts over the selection from `start`, `{N}` is its size; the first of each is filled in."""
    chosen = selection(pages, doc, page, spec)
    n, total = (F.col("pos") + F.lit(start)).cast("string"), F.col("n_selected").cast("string")

    def once(text, token, value):
        return F.when(F.instr(text, token) > 0, F.concat(F.substring_index(text, token, 1), value, _after(text, token))).otherwise(text)

    label = once(once(F.lit(template), "{n}", n), "{N}", total)
    return chosen.select(doc, "pos", page, label.alias("label"))


def _after(text, token: str):
    """What follows the first occurrence of a token."""
    return F.substring(text, F.instr(text, token) + len(token), F.length(text))


def unique_names(df: DataFrame, name: str, order: list[str], extension: str | None = None) -> DataFrame:
    """`unique_name`: the second and later rows of a name get "(2)", "(3)" and so on, in the order given."""
    keys = [name] + ([extension] if extension else [])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = F.when(nth == 1, F.col(name)).otherwise(F.format_string("%s(%d)", F.col(name), nth))
    if extension:
        numbered = F.when(F.col(extension) != "", F.concat(numbered, F.lit("."), F.col(extension))).otherwise(numbered)
    return df.withColumn("unique_name", numbered)
