"""Streams: sessions, ordered answers, quotas, trust, each with a batch form of the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import shared_path


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote. Update and complete results keep the batch number,
    so the last value of a key can be told."""
    spark = stream.sparkSession
    out, log = shared_path(spark, name), shared_path(spark, f"{name}-log")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, n: int) -> None:
            batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")  # idempotent by batch number

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = StructType(stream.schema.fields + ([StructField("_batch", IntegerType())] if mode != "append" else []))
    return spark.read.schema(schema).parquet(out).select(*schema.names)  # without the folder's batch number


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written value of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return updates.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_batch")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """SM1, SM4, SM5: runs of a key's events with less than `gap` between, with counts by outcome. Works on streams (set a
    watermark first) and tables alike."""
    g = events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "errors")


def windows(events: DataFrame, ts: str, size: str, slide: str | None = None) -> DataFrame:
    """SM9: counts in tumbling or sliding windows."""
    g = events.groupBy(F.window(ts, size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def joined(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """SM9: events of two streams (key, ts, and own columns) that have a key in common and of which the right one comes
    within `within` after the left. With the watermarks the state a stream-stream join keeps is bounded; tables join alike."""
    l, r = (x.withWatermark("ts", late) if x.isStreaming else x for x in (left, right))  # noqa: E741
    l, r = l.alias("l"), r.alias("r")  # noqa: E741
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("r.ts") >= F.col("l.ts")) & (F.col("r.ts") <= F.col("l.ts") + F.expr(f"interval {within}"))
    return l.join(r, on).select(F.col(f"l.{key}").alias(key), F.col("l.event_id").alias("left_id"), F.col("r.event_id").alias("right_id"))


def flags(events: DataFrame, key: str, ts: str, flag: Column) -> DataFrame:
    """SM11: the last value of a key's flag."""
    return events.groupBy(key).agg(F.max_by(flag, F.struct(ts, "event_id")).alias("flag"), F.max(ts).alias("at"))


def counters(events: DataFrame, key: str, day: Column) -> DataFrame:
    """AG19, AG6 of maps: counts by key and day."""
    return events.groupBy(key, day.alias("day")).agg(F.count("*").alias("n"))


def _ordered(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits a key's answers in the order of their numbers, from 0 on; later ones wait for those before them."""
    due, waiting = state.get if state.exists else (0, "")
    held = {int(k): v for k, v in (x.split("\x1f", 1) for x in waiting.split("\x1e") if x)}
    for f in frames:
        held |= dict(zip(f.turn.astype(int), f.role.astype(str), strict=True))
    out, place = [], due
    while due in held:
        out.append((key[0], due, held.pop(due)))
        due += 1
    state.update((due, "\x1e".join(f"{k}\x1f{v}" for k, v in sorted(held.items()))))
    if out:
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role"]).assign(emitted=range(place, due))


def in_order(answers: DataFrame) -> DataFrame:
    """SM2: answer n of a key (conv_id, turn, role) comes out only after n - 1; a stateful stream."""
    return answers.groupBy("conv_id").applyInPandasWithState(_ordered, "conv_id long, turn long, role string, emitted long", "due long, waiting string", "append", GroupStateTimeout.NoTimeout)


def caption_carry(messages: DataFrame, album: str, order: str, caption: str) -> DataFrame:
    """SM3: a caption holds for the later pictures of its album."""
    w = Window.partitionBy(album).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("carried", F.last(F.when(F.col(caption) != "", F.col(caption)), ignorenulls=True).over(w))


def complete(picks: DataFrame, key: str, slot: str, value: str, needed: Column) -> DataFrame:
    """SM10: questions all of whose places have a value (the last one given); the others wait."""
    last = picks.groupBy(key, slot).agg(F.max_by(value, F.struct("ts", "event_id")).alias("v"), F.max("needed" if needed is None else needed).alias("_n"))
    return last.groupBy(key).agg(F.count("*").alias("filled"), F.max("_n").alias("needed")).where("filled >= needed")


def current_only(clicks: DataFrame, plans: DataFrame, key: str, plan: str, ts: str) -> DataFrame:
    """SM8: clicks on the plan that is current at that time; older buttons are refused."""
    from ..operators.joins import as_of

    now = as_of(clicks, plans.select(key, ts, F.col(plan).alias("current")), [key], ts, ["current"])
    return now.withColumn("accepted", F.coalesce(F.col(plan) == F.col("current"), F.lit(False)))


def paced(requests: DataFrame, model: str, ts: str, per_minute: int) -> DataFrame:
    """SM6: how many of a model's requests lie in the minute up to each, and whether the pace allows it."""
    w = Window.partitionBy(model).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-59, 0)
    return requests.withColumn("in_minute", F.count("*").over(w)).withColumn("allowed", F.col("in_minute") <= per_minute)


def failover(limits: list[tuple[str, int]], used: Column, task_done: Column | None = None) -> Column:
    """SM6, UD1: the first provider, in order, whose quota isn't used up; used: map of provider to requests."""
    tries = [F.when(F.coalesce(used[name], F.lit(0)) < limit, F.lit(name)) for name, limit in limits]
    return F.coalesce(*tries)
