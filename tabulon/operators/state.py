"""Kept state: records of formats and layouts, reports of use, the hand-off of jobs, what may cross a border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, MapType, StringType, StructType, TimestampType

#: AR3: a known format: its columns with their headers and where they lie, what was learnt of each, how it did.
TEMPLATE = "template string, updated timestamp, streak long, checks long, agree long, columns array<struct<x0: double, x1: double, headers: array<string>, price: boolean>>, counts map<string, long>"
#: AR3: a known grid: its lines across and down as shares of its height and width, and the cells that hold prices.
LAYOUT = "layout string, updated timestamp, streak long, lines array<struct<across: boolean, pos: double, start: double, end: double>>, prices array<array<double>>"
_LIGHT = (StringType, BooleanType, IntegralType, FractionalType, DecimalType, DateType, TimestampType)


def is_light(kind: DataType) -> bool:
    """FI15: whether a type may cross the border between processes: plain values, and arrays, maps and structs of them."""
    if isinstance(kind, ArrayType):
        return is_light(kind.elementType)
    if isinstance(kind, MapType):
        return is_light(kind.keyType) and is_light(kind.valueType)
    if isinstance(kind, StructType):
        return all(is_light(f.dataType) for f in kind.fields)
    return isinstance(kind, _LIGHT)


def light_only(rows: DataFrame) -> DataFrame:
    """FI15: the rows, or an error that names the columns that may not cross."""
    heavy = [f.name for f in rows.schema.fields if not is_light(f.dataType)]
    if heavy:
        raise TypeError(f"not plain values: {', '.join(heavy)}")
    return rows


def hand_off(jobs: DataFrame, most_tries: int = 3) -> DataFrame:
    """SM7: what becomes of the jobs (id, started, tries) of an engine that stopped: one it had begun, or that has been
    tried `most_tries` times, fails; the others go to the next engine, with one more try."""
    fails = F.col("started") | (F.col("tries") >= most_tries)
    return jobs.withColumns({"action": F.when(fails, "fail").otherwise("resubmit"), "tries": F.col("tries") + F.when(fails, 0).otherwise(1), "started": F.lit(False)})


def tick(ts: Column, every: int = 300) -> Column:
    """SM12: the housekeeping tick that a time falls to: the start of its span of `every` seconds."""
    return F.timestamp_seconds(F.floor(ts.cast("timestamp").cast("long") / every) * every)


def due(last: Column, now: Column, every: int = 300) -> Column:
    """SM12: whether the housekeeping is due again."""
    return F.coalesce(now.cast("timestamp").cast("long") - last.cast("timestamp").cast("long") >= every, F.lit(True))


def usage_report(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """PR14: a line a model and day: what was used, of how much, what is left, and whether the provider said it is used up.
    usage: model, day, requests, tokens_in, tokens_out, exhausted; limits: model, per_day (a few rows)."""
    u = usage.join(F.broadcast(limits), "model", "left")
    left = F.when(F.col("exhausted"), 0).otherwise(F.greatest(F.lit(0), F.col("per_day") - F.col("requests")))
    of = F.when(F.col("per_day").isNotNull(), F.concat(F.lit(" of "), F.col("per_day").cast("string"), F.lit(", "), left.cast("string"), F.lit(" left"))).otherwise("")
    text = F.concat("model", F.lit(": "), F.col("requests").cast("string"), of, F.when(F.col("exhausted"), " (used up)").otherwise(""), F.lit("; tokens "), F.col("tokens_in").cast("string"), F.lit(" in, "), F.col("tokens_out").cast("string"), F.lit(" out"))
    return u.select("day", "model", text.alias("line"))


def group_report(counts: DataFrame) -> DataFrame:
    """PR14, AG1: a line a group, in the order of its first price: counts: grp, n, first_ord."""
    name = F.when(F.coalesce(F.col("grp"), F.lit("")) == "", "no group").otherwise(F.col("grp"))
    return counts.select("first_ord", F.concat(name, F.lit(": "), F.col("n").cast("string")).alias("line"))


def restore(kept: DataFrame, backup: DataFrame, keys: list[str], mode: str = "merge") -> DataFrame:
    """SE5: a backup into what is kept: `merge` adds the rows whose key isn't there yet, `replace` takes the backup's rows
    alone; a key the backup has twice counts once."""
    if mode not in ("merge", "replace"):
        raise ValueError(f"merge or replace, not {mode}")
    once = backup.dropDuplicates(keys)
    return once if mode == "replace" else kept.unionByName(once.join(kept.select(*keys), keys, "left_anti"))
