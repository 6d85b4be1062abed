"""Sequence operators: fills, change points, streaks, islands. Each window is partitioned by a document or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def _w(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def forward_fill(value: Column, keys, order) -> Column:
    """WI1: the last value that isn't null, down the order."""
    return F.last(value, ignorenulls=True).over(_w(keys, *order).rowsBetween(Window.unboundedPreceding, 0))


def back_fill(value: Column, keys, order) -> Column:
    """WI3: the next value that isn't null."""
    return F.first(value, ignorenulls=True).over(_w(keys, *order).rowsBetween(0, Window.unboundedFollowing))


def is_change(value: Column, keys, order) -> Column:
    """WI2: whether the value differs from the row before (the first row: always)."""
    w = _w(keys, *order)
    return (F.row_number().over(w) == 1) | ~value.eqNullSafe(F.lag(value).over(w))


def title_rows(rows: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """WI2: rows with one more before each change of group, half a place up."""
    rows = rows.withColumn("_new", is_change(F.col(group), keys, [order]))
    titles = rows.where(F.col("_new") & (F.col(group) != "")).select(*keys, (F.col(order) - 0.5).alias("ord"), F.lit("title").alias("kind"), F.col(group).alias("text"))
    items = rows.select(*keys, F.col(order).cast("double").alias("ord"), F.lit("item").alias("kind"), F.col(group).alias("text"))
    return titles.unionByName(items)


def restarts(number: Column, keys, order) -> Column:
    """WI4: a row number of 1 after a larger one."""
    return F.coalesce((number == 1) & (F.lag(number).over(_w(keys, *order)) > 1), F.lit(False))


def _in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in one order, dealt to ranges (`_range`) of about equal size, written once so that the ranges stay."""
    return cut(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Adds each row's place, from 0, in an order of the whole table: a sort into ranges, places within each, and before
    them the sizes of the ranges before it, of which there are as many as partitions. No window takes all rows."""
    held = _in_ranges(rows, order)
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = held.withColumn("_own", F.row_number().over(_w(["_range"], *order)) - 1).join(F.broadcast(before), "_range")
    return placed.withColumn(out, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def with_restarts(rows: DataFrame, number: str, order: list[str], out: str = "restart") -> DataFrame:
    """WI4 down a whole table: its rows sorted into ranges; a range's first row follows the last number of the range
    before, one row a range, of which there are as many as partitions."""
    held = _in_ranges(rows, order)
    last = held.groupBy("_range").agg(F.max_by(number, F.struct(*order)).alias("_last"))
    carried = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    w = _w(["_range"], *order)
    before = F.when(F.row_number().over(w) == 1, F.col("_carried")).otherwise(F.lag(number).over(w))
    met = held.join(F.broadcast(carried), "_range").withColumn("_before", before)
    return met.withColumn(out, F.coalesce((F.col(number) == 1) & (F.col("_before") > 1), F.lit(False))).drop("_range", "_carried", "_before")


def streak(ok: Column, keys, order) -> Column:
    """WI5: how many in a row are true, up to here; 0 at a false one."""
    breaks = F.sum(F.when(ok, 0).otherwise(1)).over(_w(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
    # the rows of an island since its break: counted within (keys, breaks)
    return breaks


def with_streak(rows: DataFrame, ok: str, keys: list[str], order: list[str], out: str = "streak") -> DataFrame:
    """WI5: gaps and islands: the island is the number of breaks so far, the streak its true rows so far."""
    rows = rows.withColumn("_island", streak(F.col(ok), keys, order))
    w = _w([*keys, "_island"], *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(F.col(ok).cast("int")).over(w)).drop("_island")


def ready(ok: Column, keys, order, last: int = 20, share: float = 0.95, tail: int = 5) -> Column:
    """WI6: the last 20 are known, 95 % of them right, the last 5 all right."""
    w = _w(keys, *order)
    near, end = w.rowsBetween(1 - last, 0), w.rowsBetween(1 - tail, 0)
    n = F.count(ok).over(near)
    return (n >= last) & (F.sum(ok.cast("int")).over(near) >= share * n) & (F.min(ok.cast("int")).over(end) == 1)


def smooth(z: Column, keys, least: int = 3, own: float = 0.7) -> Column:
    """WI7: 0.7 of a row's value and 0.3 of its column's mean, in columns of 3 rows or more."""
    w = Window.partitionBy(*keys)
    return F.when(F.count(z).over(w) >= least, own * z + (1 - own) * F.avg(z).over(w)).otherwise(z)


def length_outlier(length: Column, keys, by: int = 2, least: int = 3) -> Column:
    """WI8: two or more away from the column's median, in columns of 3 rows or more."""
    w = Window.partitionBy(*keys)
    return (F.count(length).over(w) >= least) & (F.abs(length - F.percentile(length, 0.5).over(w)) >= by)


def order_by_number(rows: DataFrame, keys: list[str], title: str, number: str, order: str) -> DataFrame:
    """WI9: within the segments that titles part, rows are put in order of their numbers, where a segment has 3 rows,
    95 % of the numbers differ, none is over 5 digits and they aren't in order already; else they stay."""
    rows = rows.withColumn("_seg", F.sum(F.when(F.col(title), 1).otherwise(0)).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*keys, "_seg")
    n = F.when(~F.col(title), F.col(number))
    rows = rows.withColumn("_n", n).withColumn("_down", F.coalesce(F.lag("_n").over(w.orderBy(order)) > F.col("_n"), F.lit(False)))
    distinct = F.size(F.collect_set("_n").over(w))
    ok = (F.count("_n").over(w) >= 3) & (distinct >= 0.95 * F.count("_n").over(w)) & (F.max("_n").over(w) < 100_000) & F.max("_down").over(w) & (F.count("_n").over(w) == F.sum((~F.col(title)).cast("int")).over(w))
    rows = rows.withColumn("_ok", ok)
    key = F.when(F.col(title), F.lit(-1)).when(F.col("_ok"), F.col("_n")).otherwise(F.lit(0))
    return rows.withColumn("place", F.row_number().over(_w(keys, "_seg", key, order))).drop("_seg", "_n", "_down", "_ok")


def islands(start: Column, end: Column, keys, order, gap: Column) -> Column:
    """WI10, SC22, AG7: number of the island of an interval; a new one begins where the start lies more than `gap`
    beyond the furthest end so far, and at every interval without a start."""
    w = _w(keys, *order)
    furthest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(start - furthest <= gap, 0).otherwise(1)


def with_islands(rows: DataFrame, start: str, end: str, keys: list[str], order: list[str], gap, out: str = "island") -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in order]
    rows = rows.withColumn("_new", islands(F.col(start), F.col(end), keys, order, gap if isinstance(gap, Column) else F.lit(gap)))
    return rows.withColumn(out, F.sum("_new").over(_w(keys, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def repeats_recent(parts: list[Column], keys, order, back: int = 4) -> Column:
    """WI11: equal in all parts to one of the last `back` rows."""
    w = _w(keys, *order)
    out = F.lit(False)
    for k in range(1, back + 1):
        same = F.lit(True)
        for p in parts:
            same = same & p.eqNullSafe(F.lag(p, k).over(w))
        out = out | (same & (F.row_number().over(w) > k))
    return out


def recent_count(ts: Column, keys, seconds: int = 60) -> Column:
    """WI14: how many requests in the last 60 seconds, this one included."""
    w = Window.partitionBy(*keys).orderBy(ts.cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return F.count(F.lit(1)).over(w)


def same_run(value: Column, keys, order, tolerance: float) -> Column:
    """WI16: 1 where a run of nearly equal values starts; a row without a value is a run of its own."""
    before = F.lag(value).over(_w(keys, *order))
    return F.when(F.abs(value - before) <= tolerance, 0).otherwise(1)


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """SO3, SK7: the newest n rows of a key (Spark plans a WindowGroupLimit)."""
    return rows.withColumn("_n", F.row_number().over(_w(keys, *order))).where(F.col("_n") <= n).drop("_n")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """AG24: the first row of each key."""
    return newest(rows, keys, order, 1)
