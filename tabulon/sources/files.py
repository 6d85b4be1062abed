"""Sources and sinks: files sniffed by content, landed tables, samples, backups, reports."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import recover, replace_table

TOKENS = "doc string, page int, tok int, kind string, text string, x0 double, y0 double, x1 double, y1 double, attached boolean, conf double, source string"
SAMPLES = "f array<string>, y int"


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SC1, SC18: files of a folder with their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def file_kind(content: Column) -> Column:
    """SC1: pdf (its mark within the first 1024 bytes), image (magic bytes), or null."""
    head = F.hex(F.substring(content, 1, 1024))
    mark = F.regexp_extract(head, "^(?:..)*?(25504446)", 1) != ""
    image = F.startswith(head, F.lit("89504E470D0A1A0A")) | F.startswith(head, F.lit("FFD8FF")) | F.startswith(head, F.lit("47494638")) | F.startswith(head, F.lit("424D")) | (F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"))
    return F.when(mark, "pdf").when(image, "image")


def tokens(spark: SparkSession, text_layer: str | None = None, ocr: str | None = None) -> DataFrame:
    """SC8: the page relation from landed Parquet, of text layers and of OCR, as one table."""
    parts = [spark.read.schema(TOKENS).parquet(p).withColumn("source", F.lit(s)) for p, s in ((text_layer, "pdf"), (ocr, "ocr")) if p]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def samples(spark: SparkSession, path: str) -> DataFrame:
    """SC12: training samples, one JSON object a line; malformed lines go."""
    return spark.read.schema(SAMPLES).option("mode", "DROPMALFORMED").json(path).where("f is not null and y in (0, 1)")


def landed_answers(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """SC9, SC10, SC25, AR2: remote answers as nested columns; an answer that isn't JSON is null, for the caller to skip."""
    return raw.withColumn("answer", F.from_json(column, schema))


def page_mode(candidates: Column, coverage: Column) -> Column:
    """SC19: struct(mode, warn): text where there are candidates; else raster where pictures cover over 2 %, else empty;
    a warning where more than 30 % is covered but nothing was read."""
    mode = F.when(candidates > 0, "text").when(coverage > 0.02, "raster").otherwise("empty")
    return F.struct(mode.alias("mode"), ((candidates == 0) & (coverage > 0.3)).alias("warn"))


def number_tokens(line: Column) -> Column:
    """SC20: runs of digits and separators in a line, from a digit to a digit."""
    return F.regexp_extract_all(line, F.lit(r"([0-9۰-۹٠-٩](?:[0-9۰-۹٠-٩,٬،/.'’٫]*[0-9۰-۹٠-٩])?)"))


def longest_spans(words: DataFrame, keys: list[str], known: DataFrame, most: int = 5) -> DataFrame:
    """SC21: runs of up to five words found in `known` (text), longest first from the left; spans inside a taken one go."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ord")
    spans = None
    for k in range(1, most + 1):
        text = F.array_join(F.collect_list("text").over(w.rowsBetween(0, k - 1)), "")
        part = words.withColumn("_t", text).withColumn("_left", F.count("*").over(w.rowsBetween(0, k - 1))).where(F.col("_left") == k)
        part = part.select(*keys, F.col("ord").alias("start"), F.lit(k).alias("len"), F.col("_t").alias("text"))
        spans = part if spans is None else spans.unionByName(part)
    hit = spans.join(known.select("text").distinct(), "text", "left_semi")
    best = hit.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "start").orderBy(F.col("len").desc()))).where("_k = 1").drop("_k")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        end, rows = -1, []
        for r in pdf.sort_values("start").itertuples():
            if r.start > end:
                rows.append(r.Index)
                end = r.start + r.len - 1
        return pdf.loc[rows]

    return best.groupBy(*keys).applyInPandas(take, best.schema)


def read_backups(spark: SparkSession, path: str, kind: str = "brain") -> DataFrame:
    """SC14: (path, name, content) of the members of backups with a valid manifest; others give no rows."""

    def unzip(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf.path, pdf.content, strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(c))
                    manifest = json.loads(z.read("manifest.json"))
                except (zipfile.BadZipFile, KeyError, ValueError):
                    continue
                if manifest.get("kind") == kind:
                    rows += [(p, n, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n != "manifest.json"]
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return binary_files(spark, path, "*.zip").select("path", "content").mapInPandas(unzip, "path string, name string, content string")


def newest_model(models: DataFrame) -> DataFrame:
    """SC26: of the models that can answer: a latest alias first, then stable ones before previews, then the newest."""
    version = F.coalesce(F.regexp_extract("name", r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    ok = models.where("can_generate")
    return ok.orderBy(F.endswith("name", F.lit("latest")).desc(), F.contains("name", F.lit("preview")), version.desc(), "name").limit(1)


def write_changes(changes: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",), by: str | None = None) -> list[str]:
    """SK3, SK4, SK9, QL9: the change report in several formats, computed once."""
    held, out = changes.persist(), []
    try:
        for fmt in formats:
            writer = held.write.mode("overwrite").format(fmt)
            if fmt == "csv":
                writer = writer.option("header", "true")
            (writer.partitionBy(by) if by else writer).save(f"{path}/{fmt}")
            out.append(f"{path}/{fmt}")
    finally:
        held.unpersist()
    return out


def snapshot(table: DataFrame, root: str, version: int, keep: int = 5) -> list[str]:
    """SK8, SM13: writes a version of a table and drops all but the newest `keep`; undo reads the one before."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{root}/v={version:010d}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path))
    for old in names[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, old), True)
    return names[-keep:]


def append_or_compact(new: DataFrame, path: str, cap: int, order: str = "seq") -> int:
    """SK7, ML19: appends rows; beyond 1.2 times the cap the newest `cap` take the table's place, as a whole."""
    spark = new.sparkSession
    recover(spark, path)
    new.write.mode("append").parquet(path)
    n = spark.read.parquet(path).count()
    if n > 1.2 * cap:
        replace_table(spark.read.parquet(path).orderBy(F.col(order).desc()).limit(cap), path)
        return cap
    return n


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC11: kept state (model weights, formats, layouts, statistics) from JSON, one record a line or a file that holds an
    array, as typed nested rows; a record that isn't JSON comes as nulls and is left out."""
    kinds = StructType.fromDDL(schema)
    rows = spark.read.schema(StructType([*kinds.fields, StructField("_bad", StringType())])).option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return rows.select("*").where(F.col("_bad").isNull()).drop("_bad")


def shape_library(spark: SparkSession, path: str) -> DataFrame:
    """SC13: (label, id, vec) of the arrays of NPZ files: each named array holds a label's shapes, a row each. Object
    arrays, which would need unpickling, and files that aren't NPZ give no rows."""

    def read(batches):
        for pdf in batches:
            rows = []
            for content in pdf.content:
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as held:
                        for label in held.files:
                            shapes = np.atleast_2d(held[label])
                            rows += [(label, i, v) for i, v in enumerate(shapes.reshape(len(shapes), -1).astype(float).tolist())]
                except (ValueError, OSError, zipfile.BadZipFile):
                    continue
            yield pd.DataFrame(rows, columns=["label", "id", "vec"])

    return binary_files(spark, path, "*.npz").select("content").mapInPandas(read, "label string, id long, vec array<double>")


_FILE = "struct<file_id: string, file_name: string, mime_type: string>"
UPDATE = f"update_id long, message struct<message_id: long, date: long, chat: struct<id: long>, text: string, caption: string, media_group_id: string, document: {_FILE}, photo: array<struct<file_id: string, width: int, height: int>>>, callback_query struct<id: string, data: string, message: struct<message_id: long, chat: struct<id: long>>>"


def chat_updates(raw: DataFrame, column: str = "value", after: int = -1) -> DataFrame:
    """SC16: landed chat updates (a JSON object a row) as (update_id, chat, message_id, kind, file_id, name, text, album,
    button): files, photos (the largest one), texts and pressed buttons after an update number, each number once. Works on
    streams and tables alike, but for the once, which a stream's watermark has to bound."""
    u = raw.select(F.from_json(column, UPDATE).alias("u")).where(F.col("u.update_id") > after).select("u.*")
    m, b = F.col("message"), F.col("callback_query")
    photo = F.array_max(F.transform(m["photo"], lambda p: F.struct((p["width"] * p["height"]).alias("size"), p["file_id"].alias("file_id"))))["file_id"]
    kind = F.when(b.isNotNull(), "button").when(m["document"].isNotNull(), "file").when(F.size(m["photo"]) > 0, "photo").when(m["text"].isNotNull(), "text")
    out = u.select(
        "update_id", F.coalesce(m["chat"]["id"], b["message"]["chat"]["id"]).alias("chat"), F.coalesce(m["message_id"], b["message"]["message_id"]).alias("message_id"), kind.alias("kind"),
        F.coalesce(m["document"]["file_id"], photo).alias("file_id"), m["document"]["file_name"].alias("name"), F.coalesce(m["text"], m["caption"]).alias("text"), m["media_group_id"].alias("album"), b["data"].alias("button"),
    )
    out = out.where("kind is not null")
    return out if raw.isStreaming else out.dropDuplicates(["update_id"])
