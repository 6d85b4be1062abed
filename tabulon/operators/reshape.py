"""Tables from cells: blocks, column merges, unions. Cells stay long: (tbl, row, col, text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_continued(tables: DataFrame, header: Column, order: str, keys: list[str] = ()) -> DataFrame:
    """SE1: `merged`: number of the run of consecutive tables with the same header."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(header).over(w).eqNullSafe(header) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return tables.withColumn("_new", new).withColumn("merged", F.sum("_new").over(w)).drop("_new")


def header_alike(a: Column, b: Column) -> Column:
    """SE1: equal headers, or of four columns and more all but one equal."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda z: z))
    return (F.size(a) == F.size(b)) & ((same == F.size(a)) | ((F.size(a) >= 4) & (same >= F.size(a) - 1)))


def unpivot_blocks(wide: DataFrame, ids: list[str], blocks: list[list[str]], names: list[str]) -> DataFrame:
    """SE2: blocks of columns side by side, one below the other; ordered by (block, row) afterwards."""
    parts = F.array(*(F.struct(F.lit(k).alias("block"), *(F.col(c).alias(n) for c, n in zip(cols, names, strict=True))) for k, cols in enumerate(blocks)))
    return wide.select(*ids, F.explode(parts).alias("_b")).select(*ids, "_b.*")


def header_period(headers: list[str]) -> int:
    """SE2: the least number of columns after which the headers repeat, all of them if they don't."""
    return next(p for p in range(1, len(headers) + 1) if len(headers) % p == 0 and all(h == headers[i % p] for i, h in enumerate(headers)))


def merge_split_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """SE3: neighbouring columns of one table that no row fills both, and that share a header, become one; the text of a
    cell is what its parts hold. Works on filled cells (row, col, text, header)."""
    full = cells.where("text <> ''")
    w = Window.partitionBy(*keys, "row").orderBy("col")
    both = full.withColumn("_next", F.lead("col").over(w)).where("_next = col + 1").groupBy(*keys, F.col("_next").alias("col")).agg(F.lit(True).alias("_both"))
    cols = full.groupBy(*keys, "col").agg(F.max("header").alias("header")).join(both, [*keys, "col"], "left")
    by = Window.partitionBy(*keys).orderBy("col")
    joins = F.col("_both").isNull() & (F.lag("col").over(by) == F.col("col") - 1) & F.lag("header").over(by).eqNullSafe(F.col("header"))
    cols = cols.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("to_col", F.sum("_new").over(by))
    out = full.join(cols.select(*keys, "col", "to_col"), [*keys, "col"])
    return out.groupBy(*keys, "row", "to_col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " ").alias("text"))


def drop_empty_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """SE3: without columns that no cell fills; those left are numbered anew."""
    used = cells.groupBy(*keys, "col").agg(F.max(F.col("text") != "").alias("_u")).where("_u").withColumn("to_col", F.row_number().over(Window.partitionBy(*keys).orderBy("col")) - 1)
    return cells.join(used.drop("_u"), [*keys, "col"]).select(*keys, "row", F.col("to_col").alias("col"), "text")


def row_kind(n_cells: Column, n_prices: Column, has_header: Column, spans_all: Column) -> Column:
    """SE6: what a row of a grid is."""
    return F.when(n_prices > 0, "item").when(has_header, "header").when(spans_all, "group").when(n_cells > 0, "item").otherwise("empty")


def jaccard(a: Column, b: Column) -> Column:
    """SE4: of two arrays as sets, 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers of a line from the left; one of 1 to 3 digits joins the one after it if that begins with three digits and
    a separator and they nearly touch."""
    out = []
    for r in pdf.sort_values(["x0", "id"]).itertuples():
        last = out[-1] if out else None
        if last and last["text"].isdigit() and len(last["text"]) <= 3 and len(r.text) > 3 and r.text[:3].isdigit() and r.text[3] in ",/." and r.x0 - last["x1"] <= r.gap:
            last.update(text=f"{last['text']}{r.text[3]}{r.text}", x1=r.x1)
        else:
            out.append({"line": r.line, "id": r.id, "text": r.text, "x1": r.x1})
    return pd.DataFrame(out, columns=["line", "id", "text", "x1"])


def join_pieces(numbers: DataFrame) -> DataFrame:
    """WI12: numbers (line, id, text, x0, x1, gap) that were split apart, joined from the left; a line a group."""
    return numbers.groupBy("line").applyInPandas(_join_pieces, "line long, id long, text string, x1 double")


def paginate(rows: DataFrame, height: str, room: float, keys: list[str], order: str, header: str) -> DataFrame:
    """SK11: page of each row: filled from the top; a header goes over with the row after it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order).reset_index(drop=True)
        page, left, out = 0, room, []
        for i, r in p.iterrows():
            need = r[height] + (p[height][i + 1] if r[header] and i + 1 < len(p) else 0)
            if need > left and left < room:
                page, left = page + 1, room
            left -= r[height]
            out.append(page)
        return p.assign(page=out)

    return rows.groupBy(*keys).applyInPandas(run, rows.withColumn("page", F.lit(0)).schema)
