"""Shared pieces of the corpus operators: scratch tables, ids and splits."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id acts as the largest one.
NO_ID = 2**63 - 1
#: Bytes that separate words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders and warehouse tables written here that nothing has deleted yet.
_SCRATCH: set[str] = set()
_TABLES: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a local one in local mode, as in tests; on a
    cluster, whose machines don't share local folders, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='tabulon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A new folder's name in the shared folder."""
    path = f"{shared_dir(spark)}/tabulon/{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new bucketed table's name in the warehouse."""
    table = f"tabulon_{name}_{uuid.uuid4().hex}"
    _TABLES.add(table)
    return table


def drop_tables(spark: SparkSession, *tables: str) -> None:
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t} PURGE")
        _TABLES.discard(t)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | str) -> None:
    """Deletes tables written by cut(), or folders named by scratch_path(), that nothing reads any more."""
    spark = SparkSession.getActiveSession()
    for df in frames:
        path = df if isinstance(df, str) else getattr(df, "_scratch", None)
        if path and spark:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            _SCRATCH.discard(path)


def clear_scratch() -> int:
    """Deletes all folders and tables that results still read from: to be called when no result of this session is needed
    any more, as at its end. Returns how many there were."""
    spark, held, tables = SparkSession.getActiveSession(), list(_SCRATCH), list(_TABLES)
    discard(*held)
    if spark:
        drop_tables(spark, *tables)
    return len(held) + len(tables)


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def texts(docs: DataFrame) -> DataFrame:
    """(doc, text) of documents: nulls become the largest id and the empty text; other columns go."""
    return docs.select(id_of().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))


def balanced_sample(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc, y) of labelled rows (doc_id, `column` of 0 or 1): at most max_rows documents, half of each class, those with
    the least hashes of their ids. Each class is one top-n over the labels, without gathering them at two keys. A
    document with several labels has the largest; rows with nulls or other labels don't count."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(column).cast("int").alias("y"))
    return union([known.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(max_rows // 2) for y in (0, 1)])


def wrapped(df: DataFrame, *own: Column) -> DataFrame:
    """All columns of df as one, `_row`, and own ones beside it, so that no name of df can clash with them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row") if df.columns else F.struct().alias("_row"), *own)


def unwrapped(names: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in names]


def split_hot(counts: DataFrame, n: str, total: int, share: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Splits keys with their row counts into at most `share` hot keys (each over 1/share of all rows, so there
    can't be more of them) and the rest, of which none has more than 1/share of the rows."""
    most = max(total // share, 1)
    return counts.where(F.col(n) > most), counts.where(F.col(n) <= most)


def join_hot(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int, share: int = 20_000) -> DataFrame:
    """Inner join of rows with one row a key in counts: the hot keys, at most `share` by their definition, are
    broadcast; the rest is shuffled, with at most 1/share of the rows at one key."""
    hot, rest = split_hot(counts, n, total, share)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(rest.hint("merge"), keys))


def join_salted(rows: DataFrame, other: DataFrame, key: str, salts: int = 32, share: int = 20_000) -> DataFrame:
    """Inner join on a key that both sides may hold many times: rows of a hot key (over 1/share of all rows, so at most
    `share` keys, whose list is broadcast) are dealt to `salts` groups, and the other side's rows of that key go to each
    of them."""
    rows = cut(rows, "salted")
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = cut(split_hot(counts, "_n", rows.count(), share)[0].select(key, F.lit(True).alias("_hot")), "hot")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right.hint("merge"), [key, "_salt"]).drop("_salt")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
