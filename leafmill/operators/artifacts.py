"""Artifacts of an operation: their names, embedded images and masks, redaction marks, form plans, copy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import artifact_discriminator, extension, output_name, trimmed
from leafmill.operators.pages import unique_names

#: File extensions by MIME type, where they are not the subtype's name.
EXTENSIONS = {
    "image/jpeg": "jpg", "image/svg+xml": "svg", "image/tiff": "tif", "text/plain": "txt", "text/markdown": "md", "application/x-7z-compressed": "7z",
    "application/gzip": "gz", "audio/mpeg": "mp3", "video/quicktime": "mov", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}


def named(artifacts: DataFrame, run: str, order: str, name: str, source: str, op: Column, params: Column, time: Column) -> DataFrame:
    """`new_name` for every artifact of a run: by the template, with what tells several apart, and no name twice.

    What tells an artifact apart is what its name adds to its source's, or else its number.
    """
    by = Window.partitionBy(run)
    rows = artifacts.withColumns({"_k": F.row_number().over(by.orderBy(order)), "_n": F.count("*").over(by), "_ext": extension(F.col(name))})
    base = F.when(F.coalesce(F.col(source), F.lit("")) != "", F.col(source)).otherwise(F.col(name))
    apart = artifact_discriminator(F.col(name), F.coalesce(F.col(source), F.lit("")))
    made = output_name(base, op, params, time)
    several = F.concat(made, F.lit("-"), F.when(apart != "", apart).otherwise(F.format_string("%02d", F.col("_k"))))
    rows = rows.withColumn("_name", F.concat(F.when(F.col("_n") > 1, several).otherwise(made)))
    found = unique_names(rows.withColumn("_run_name", F.concat_ws("\u0000", F.col(run).cast("string"), "_name")), "_run_name", [order], "_ext")
    return found.withColumn("new_name", F.substring_index("unique_name", "\u0000", -1)).drop("_k", "_n", "_ext", "_name", "_run_name", "unique_name")


def page_image_name(base: Column, page: Column) -> Column:
    """"report_p007" for page 6."""
    return F.format_string("%s_p%03d", base, page + 1)


def owner_pages(uses: DataFrame, doc: str, ref: str, page: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, ref, pages, first_page): the pages that show each embedded image; with `wanted` (doc, page), images on those pages only."""
    shown = uses.select(doc, ref, page).distinct()
    if wanted is not None:
        shown = shown.join(shown.join(wanted, [doc, page], "left_semi").select(doc, ref).distinct(), [doc, ref], "left_semi")
    return shown.groupBy(doc, ref).agg(F.count("*").alias("pages"), F.min(page).alias("first_page"))


def mask_hosts(images: DataFrame, doc: str, ref: str, mask: str) -> DataFrame:
    """(doc, ref, mask, shared): images with their masks; a mask that several images use must not be changed with one of them."""
    masked = images.where(F.col(mask).isNotNull()).select(doc, ref, mask)
    users = masked.groupBy(doc, mask).agg(F.countDistinct(ref).alias("_users"))
    return masked.join(users, [doc, mask]).select(doc, ref, mask, (F.col("_users") > 1).alias("shared"))


def marks_by_page(marks: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """(doc, page, marks): the boxes to black out on each page, in order."""
    box = F.struct(F.col(order).alias("order"), "x0", "y0", "x1", "y1")
    return marks.groupBy(doc, page).agg(F.array_sort(F.collect_list(box)).alias("marks"))


def form_plan(fields: DataFrame, values: DataFrame, doc: str, field: str) -> DataFrame:
    """(doc, field, type, value, error): what a form would be filled with; unknown fields and values of a wrong kind are errors."""
    joined = values.join(fields, [doc, field], "left")
    yes = F.lower("value").isin("true", "1", "yes", "on")
    error = (
        F.when(F.col("type").isNull(), F.lit("no such field"))
        .when((F.col("type") == "checkbox") & ~yes & ~F.lower("value").isin("false", "0", "no", "off", ""), F.lit("not a yes or no"))
        .when(F.col("type").isin("choice", "radio") & ~F.coalesce(F.array_contains("options", F.col("value")), F.lit(False)), F.lit("not one of the options"))
    )
    value = F.when(error.isNull(), F.when(F.col("type") == "checkbox", yes.cast("string")).otherwise(F.col("value")))
    return joined.select(doc, field, "type", value.alias("value"), error.alias("error"))


def extension_of_mime(mime: Column) -> Column:
    """A file extension for a MIME type: known ones, else the subtype, else "bin"."""
    m = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    sub = F.regexp_extract(m, r"^[^/]+/([-\w.]{1,12})$", 1)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), m)
    return F.coalesce(known, F.nullif(F.regexp_replace(sub, "^x-", ""), F.lit("")), F.lit("bin"))


def copy_plan(files: DataFrame, group: str, order: str, mime: str, custom: bool = True) -> DataFrame:
    """`plan` for each file that is to be copied: the first image as an image, other files in a format of their own if that can be."""
    image = F.lower(mime).startswith("image/")
    nth = F.sum(image.cast("int")).over(Window.partitionBy(group).orderBy(order))
    other = F.lit("custom" if custom else "error")
    return files.withColumn("plan", F.when(image & (nth == 1), F.lit("image")).when(image, F.lit("error")).otherwise(other))


def light(records: DataFrame, lists: list[str], blobs: list[str]) -> DataFrame:
    """Records without their contents: lists as their lengths, blobs as whether there are any."""
    out = records
    for c in lists:
        out = out.withColumn(f"n_{c}", F.coalesce(F.size(c), F.lit(0))).drop(c)
    for c in blobs:
        out = out.withColumn(f"has_{c}", F.col(c).isNotNull()).drop(c)
    return out


def custom_pairs(lines: Column) -> Column:
    """array<struct<base, over>>, 0-based, from lines "1:2"; a line that is none fails the query."""
    kept = F.filter(F.transform(F.split(lines, "\n"), trimmed), lambda x: x != "")
    form = r"^(\d{1,9})\s*[:：,]\s*(\d{1,9})$"
    checked = F.transform(kept, lambda x: F.when(x.rlike(form), x).otherwise(F.raise_error(F.concat(F.lit("not a pair of pages: "), x)).cast("string")))
    return F.transform(checked, lambda x: F.struct((F.regexp_extract(x, form, 1).cast("int") - 1).alias("base"), (F.regexp_extract(x, form, 2).cast("int") - 1).alias("over")))


def similarity_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, similarity, similarity_min): mean and least over the sampled pages, four digits."""
    return samples.groupBy(group).agg(F.round(F.avg(value), 4).alias("similarity"), F.round(F.min(value), 4).alias("similarity_min"))


def log_text(lines: DataFrame, group: str, order: str, line: str, most: int | None = 500) -> DataFrame:
    """(group, text): the newest lines of a log in order, no more than a log holds, so that a text is bounded.  Without `most`, all lines."""
    newest = Window.partitionBy(group).orderBy(F.desc(order))
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    lines = lines if most is None else lines.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    return lines.groupBy(group).agg(F.array_join(F.transform(entries, lambda e: e["l"]), "\n").alias("text"))


def folded(steps: list, documents: DataFrame) -> DataFrame:
    """A workflow: each step's result is the next one's input; a step without a result leaves its input."""
    for step in steps:
        result = step(documents)
        documents = documents if result is None else result
    return documents
