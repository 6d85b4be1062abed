"""The list tables, as made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of parts: a pattern of one name takes both."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as priced items: id, grp, label, value, decimals."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_name").alias("label"), F.col("p_retailprice").cast("decimal(18,2)").alias("value"), F.lit(2).alias("decimals"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes on pages: page, id, x0..y1, text."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_linenumber") * 10.0, F.col("l_quantity")
    return l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 4).alias("y1"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def wide_pages(b: DataFrame, n: int = 64) -> DataFrame:
    """The same boxes with n pages side by side on each page, for steps that take a page as a group."""
    shift = F.col("page") % n * 100.0
    return b.withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift, "id": F.col("id") + F.col("page") % n * 100, "page": F.floor(F.col("page") / n)})


BOXES = """(SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS id, l_linenumber * 10.0::DOUBLE AS x0, l_quantity AS y0,
  l_linenumber * 10.0::DOUBLE + 8 AS x1, l_quantity + 4 AS y1, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""
ITEMS = "(SELECT p_partkey AS id, p_brand AS grp, p_name AS label, CAST(p_retailprice AS DECIMAL(18,2)) AS value FROM part)"
