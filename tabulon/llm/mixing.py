"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, join_hot, unwrapped, wrapped

#: Hash bits: three nested histograms of 4096 buckets each.
LEVELS, BITS = 3, 12


def words(text: Column) -> Column:
    """How many runs of bytes other than white space (\\x20, \\x09-\\x0D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash36(column: Column) -> Column:
    """The first 36 bits of the md5 of the id as text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def _running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds running sums (new name: column; each before its row) in an order of all rows: one range-partitioned sort, the
    sums within each partition, and before them those of the partitions before, of which there are as many as
    partitions. So the sources don't pass through one task."""
    held = cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = held.groupBy("_part").agg(*(F.sum(c).alias(f"_{new}") for new, c in sums.items()))
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{new}").over(upto), F.lit(0)).alias(f"_{new}") for new in sums))
    out = held.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(new) for new, c in sums.items()))
    out = out.join(F.broadcast(parts), "_part").withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums})
    return out.drop("_part", *(f"_{new}" for new in sums))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target` to (source, total): shares of `share` times all words by weight, weights repeating in order of
    source (null last); a target stops at `most` times its source's words, the excess going to the others by weight.
    With lambda common to all sources below their cap, target = least(cap, lambda * weight); lambda is found over the
    sources in order of cap / weight, from running sums of the caps and weights before each."""
    names = sources.columns
    s = _running(sources.withColumn("_one", F.lit(1)), [F.col("source").isNull(), "source"], {"_rank": "_one"}).drop("_one")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).drop("_rank").withColumn("cap", F.col("total") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    s = cut(_running(s, ["ratio", F.col("source").isNull(), "source"], {"caps": "cap", "ws": "w"}), "ratios")
    budget, all_w = s.agg(F.sum("total"), F.sum("w")).first()
    s = s.withColumn("lam", (F.lit((budget or 0) * float(share)) - F.col("caps")) / (F.lit(all_w) - F.col("ws")))
    lam = s.where(F.col("lam") <= F.col("ratio")).agg(F.min(F.struct("ratio", "lam")).alias("m")).select("m.lam").first()[0]
    target = F.col("cap") if lam is None else F.least(F.col("cap"), F.lit(lam) * F.col("w"))
    return s.select(*names, target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("h", BITS * (LEVELS - 1 - level))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `size` (words), `source_size`, `target` and `taken` (words the mix takes of the row, repeats counted).

    A source with target t and s words takes every row floor(t / s) times, and once more the rows whose hash lies under
    the source's threshold, so that their words come to the rest. The threshold is found by nested histograms: words by
    source and the hash's first 12 bits, then by the next 12 bits in the one bucket in which the budget ends, then once
    more; the last bucket is taken if that comes nearer. Nothing is sorted. Native operations only. What is found for a
    source reaches its rows by a broadcast for sources with more than 1/20,000 of all rows (there can't be more of them
    than that), by a merge join for the others.

    Null texts have size 0, null sources form one source (the last); rows with the same doc_id share their hash (and tie
    in it: all or none is taken once more); sources without words take nothing; an empty table gives an empty one.
    Columns of docs named like the added ones are replaced; other names can't clash.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    names = docs.columns
    source = F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key")  # a null source is a key too
    size, h = words(F.col("text")).alias("size"), hash36(F.col("doc_id")).alias("h")
    sizes = cut(docs.select(key, source.alias("source"), size, h), "sizes")
    found = sizes.groupBy("key", "source").agg(F.sum("size").alias("total"), F.count("*").alias("rows"))
    goal = cut(targets(found, weights, share, most), "targets")
    n = goal.agg(F.sum("rows")).first()[0] or 0
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    edge = goal.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("total"))
    fixed = ["key", "rows", "total", "target", "whole", "rest"]
    edge = edge.select(*fixed, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("below"))
    spent = [goal]
    for level in range(LEVELS):
        inside = sizes.select("key", "size", "h")
        if level:
            inside = join_hot(inside, edge.where(F.col("at").isNotNull()).select("key", "rows", "at"), ["key"], "rows", n).where(_bucket(level - 1) == F.col("at"))
        cells = inside.select("key", _bucket(level).alias("cell"), "size").groupBy("key", "cell").agg(F.sum("size").alias("n"))
        held = cells.withColumn("upto", F.sum("n").over(W.partitionBy("key").orderBy("cell"))).join(edge.select("key", "rest", "below"), "key")
        # the first bucket with which the words pass the rest; none: all are taken
        over = F.col("below") + F.col("upto") > F.col("rest")
        first = held.where(over).groupBy("key").agg(F.min_by(F.struct(F.col("cell").alias("at"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), (F.col("below") + F.col("upto")).alias("upto")), "cell").alias("f"))
        edge = edge.select(*fixed).join(first, "key", "left")
        edge = cut(edge.select(*fixed, F.col("f.at").alias("at"), F.coalesce("f.below", F.lit(0)).alias("below"), "f.upto"), f"edge{level}")
        spent.append(edge)
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")
    limit = F.when(F.col("at").isNull(), F.lit(1 << (BITS * LEVELS))).otherwise(F.col("at") + F.when(nearer, 1).otherwise(0))
    edge = cut(edge.select("key", "rows", F.col("total").alias("source_size"), "target", "whole", limit.alias("limit")), "limits")
    discard(sizes, *spent)
    out = join_hot(wrapped(docs, key, size, h), edge, ["key"], "rows", n)
    taken = F.col("size") * (F.col("whole") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0))
    return out.select(*unwrapped(names), "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for the query's rows, by a running sum over all rows of a source instead of histograms."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9))::BIGINT AS h FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
r AS (SELECT *, total * 2.0::DOUBLE AS cap, total * 2.0::DOUBLE / w AS ratio FROM w),
p AS (SELECT *, ((SELECT sum(total) FROM s) * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM r),
g AS (SELECT source, total, w, cap, least(cap, coalesce((SELECT arg_min(lam, ratio) FROM p WHERE lam <= ratio) * w, cap)) AS target FROM p),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS whole FROM g),
c AS (SELECT d.doc_id, d.size, d.source, h, e.total, e.target, e.whole, e.target - e.whole * e.total AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS n
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - n <= rest AND upto - rest < rest - (upto - n)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c"""
