"""Invoices: line amounts, subtotal, tax and total, as totals or as report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.tables import table

#: Where the summary rows stand after an invoice's lines.
SUMMARY = 1_000_001


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, line_no, item, qty, price) of the order lines."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line_no"), F.lit("part").alias("item"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))


def totals(rows: DataFrame, invoice: str, rate: Column) -> DataFrame:
    """(invoice, subtotal, tax, total), to the cent; rates are percent from 0 to 100, lines without an item do not count."""
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), rate))
    summed = rows.where(F.coalesce(F.trim("item"), F.lit("")) != "").groupBy(invoice).agg(F.round(F.sum(F.col("qty") * F.col("price")), 2).alias("subtotal"))
    taxed = summed.withColumn("tax", F.floor(F.col("subtotal") * percent + 0.5) / 100)
    return taxed.withColumn("total", F.round(F.col("subtotal") + F.col("tax"), 2))


def report(rows: DataFrame, invoice: str, rate: Column) -> DataFrame:
    """(invoice, line_no, item, qty, price, amount): the lines, then subtotal, tax and total."""
    named = rows.where(F.coalesce(F.trim("item"), F.lit("")) != "")
    detail = named.select(invoice, "line_no", "item", "qty", "price", F.round(F.col("qty") * F.col("price"), 2).alias("amount"))
    names = F.array(*[F.struct(F.lit(SUMMARY + k).cast("bigint").alias("line_no"), F.lit(item).alias("item"), F.col(c).alias("amount")) for k, (item, c) in enumerate((("小计", "subtotal"), ("税", "tax"), ("应收总计", "total")))])
    summary = totals(rows, invoice, rate).select(invoice, F.explode(names).alias("s")).select(invoice, "s.line_no", "s.item", F.lit(None).cast("double").alias("qty"), F.lit(None).cast("double").alias("price"), "s.amount")
    return detail.unionByName(summary)
