"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, SPACE, cut, discard, drop_tables, id_of, join_hot, partitions, scratch_path, scratch_table, union

_LOW = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(_LOW)


def _digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _halves(d: bytes) -> tuple[int, int]:
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _line_hashes(least: int):
    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in {k for x in text.split("\n") if len(x) >= least and len(k := line_key(x)) >= least}:
                    for o, v in zip(out, (doc, *_halves(_digest(key))), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["doc", "h1", "h2"])

    return run


def _rebuild(least: int, width: int):
    def run(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {(x["h1"], x["h2"]) for x in drop}
                    lines = [x for x in lines if len(x) < least or len(k := line_key(x)) < least or _halves(_digest(k)) not in gone]
                    text = "\n".join(lines)
                kept.append(text)
                n_dropped.append(n_lines[-1] - len(lines))
            rest = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *rest], names=[*batch.schema.names[:width], "kept", "n_lines", "n_dropped"])

    return run


class Runs:
    """Levelled sorted runs: each a table bucketed and sorted by hash. When `fanout` runs stand at a level, they are
    merged into one run of the next level, so a batch meets at most fanout-1 runs a level."""

    def __init__(self, spark, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.n = partitions(spark)

    def live(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, df: DataFrame) -> str:
        table = scratch_table(self.spark, "run")
        df.repartition(self.n, "h1", "h2").write.bucketBy(self.n, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(table)
        return table

    def add(self, df: DataFrame) -> None:
        self.levels[0].append(self._write(df))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged = self._write(union([self.spark.table(t) for t in self.levels[at]]))
            drop_tables(self.spark, *self.levels[at])
            self.levels[at] = []
            at += 1
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(merged)

    def mark_seen(self, df: DataFrame) -> DataFrame:
        """Adds `seen`: whether a run holds the hash. Each merge join reads a run bucket by bucket, without a shuffle of it."""
        df = df.withColumn("seen", F.lit(False))
        for t in self.live():
            run = self.spark.table(t).select("h1", "h2", F.lit(True).alias("_in"))
            df = df.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("seen", F.col("seen") | F.coalesce("_in", F.lit(False))).drop("_in")
        return df

    def close(self) -> None:
        drop_tables(self.spark, *self.live())


def dropped_hashes(docs: DataFrame, batches: int | None = None, min_chars: int = 10, fanout: int = 3, batch_chars: int = 1 << 36, least_batches: int = 4) -> DataFrame:
    """(doc, h1, h2): the line hashes that each document loses, as a table in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(id_of().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if batches is None:
        batches = max(least_batches, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // batch_chars))
    ends = rows.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], max(1000, 10 * batches))).first()[0] if batches > 1 else None
    ends = [*sorted(set(ends or [])), NO_ID]
    # each batch's lines in a folder of their own, so that no batch reads the others'
    number = F.coalesce(*(F.when(F.col("doc") <= e, i) for i, e in enumerate(ends))).alias("batch")
    path = scratch_path(spark, "lines")
    found = rows.select("doc", "text").mapInArrow(_line_hashes(min_chars), "doc long, h1 long, h2 long")
    found.select("doc", "h1", "h2", number).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc long, h1 long, h2 long, batch int").parquet(path)
    runs, drops, spent = Runs(spark, fanout), [], [path]
    for i in range(len(ends)):
        batch = lines.where(F.col("batch") == i).drop("batch")
        first = batch.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.count("*").alias("n"), F.max("doc").alias("last"))
        first = cut(runs.mark_seen(first), "firsts")
        total = first.agg(F.sum("n")).first()[0] or 0
        lose = first.where(F.col("seen") | (F.col("owner") != F.col("last"))).select("h1", "h2", "n", F.when(~F.col("seen"), F.col("owner")).alias("owner"))
        gone = join_hot(batch, lose, ["h1", "h2"], "n", total).where(F.col("owner").isNull() | (F.col("owner") != F.col("doc")))
        drops.append(cut(gone.select("doc", "h1", "h2"), "drops"))
        spent.append(first)
        if i < len(ends) - 1:
            runs.add(first.where(~F.col("seen")).select("h1", "h2"))
    runs.close()
    discard(*spent)
    return union(drops)


def dedup_lines(docs: DataFrame, batches: int | None = None, min_chars: int = 10, fanout: int = 3, batch_chars: int = 1 << 36) -> DataFrame:
    """Drops repeated lines: a line whose key (stripped of white space, A-Z lower-cased, at least `min_chars` code
    points) occurs in at least two documents stays only in the one with the smallest doc_id.

    Method: documents come in `batches` ranges of doc_id (by default four, and more beyond four times batch_chars
    characters); each batch's distinct line hashes (128 bits) are merge-joined with levelled sorted runs of the hashes
    before it; those not yet seen become a new run, and runs are compacted level by level. Very frequent hashes are
    joined by a broadcast of at most 20,000 keys.

    Returns the columns of docs and `kept` (the remaining text), `n_lines`, `n_dropped`. Null or empty texts are one
    empty line. A null doc_id acts as the largest id; rows of one id count as one document, each row keeps its own
    lines, also where it repeats one. An empty table gives an empty one. Columns of docs with those three names are
    replaced; other names can't clash.
    """
    docs = docs.drop("kept", "n_lines", "n_dropped")
    names = docs.columns
    drops = dropped_hashes(docs, batches, min_chars, fanout, batch_chars).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("_drop"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("_row"), id_of().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.col("text").isNull().alias("_null"))
    joined = rows.join(drops, "doc", "left").select("_row", "_null", "_text", "_drop")
    schema = StructType([joined.schema["_row"], joined.schema["_null"], *StructType.fromDDL("kept string, n_lines long, n_dropped long")])
    out = joined.mapInArrow(_rebuild(min_chars, 2), schema)
    text = F.when(F.col("_null"), F.lit(None).cast("string")).otherwise(F.col("kept")).alias("text")
    return out.select(*(text if c == "text" else F.col("_row").getField(c).alias(c) for c in names), "kept", "n_lines", "n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for the query's rows."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {documents}),
l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM d)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
