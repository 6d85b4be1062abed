"""Joins by place, time and likeness. Spatial joins are equi-joins on (page, band), never nested loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def bands(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def banded(left: DataFrame, right: DataFrame, keys: list[str], size: float, on: Column, how: str = "inner", pad: float = 0.0) -> DataFrame:
    """JO1, JO4, JO17, JO19, JO22, JO24, JO27: joins boxes of two tables (aliased l and r, each with x0..y1) under a
    condition that implies their y-intervals come within `pad`. Each box stands in the bands it touches; a pair is kept
    in the first band both touch, so none comes twice."""
    l = left.withColumn("_band", F.explode(bands(F.col("y0") - pad, F.col("y1") + pad, size))).alias("l")  # noqa: E741
    r = right.withColumn("_band", F.explode(bands(F.col("y0"), F.col("y1"), size))).alias("r")
    same = F.col("l._band") == F.col("r._band")
    for k in keys:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    if how in ("left_semi", "left_anti"):
        hit = l.join(r, same & on, "left_semi").select(*[F.col(f"l.{c}") for c in left.columns]).distinct()
        if how == "left_semi":
            return hit
        a, b = left.alias("a"), hit.alias("b")
        return a.join(b, reduce(and_, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in left.columns)), "left_anti")  # a null equals a null
    once = F.greatest(F.floor((F.col("l.y0") - pad) / size), F.floor(F.col("r.y0") / size)) == F.col("l._band")
    return l.join(r, same & once & on, how)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """JO2, JO3, JO21, JO26: with each left row the values of the latest right row at or before it, by one sort of the
    two tables together and a running last value: no range join, and each key is shuffled once."""
    mark = F.struct(*values)
    l = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_m", F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType))  # noqa: E741
    r = right.select(*keys, at, F.lit(1 if strict else 0).alias("_side"), mark.alias("_m"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_is_left", F.col("_m").isNull()).withColumn("_m", F.last("_m", ignorenulls=True).over(w))
    return both.where("_is_left").select(*left.columns, *(F.col(f"_m.{v}").alias(v) for v in values))


def best_by(rows: DataFrame, keys: list[str], score: Column, order: list[Column] = ()) -> DataFrame:
    """AG25, JO7, JO10, JO11, JO15, SE10: of each key the row with the best score; ties by the order."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def smallest_container(boxes: DataFrame, areas: DataFrame, keys: list[str], size: float, value: str) -> DataFrame:
    """JO24: with each box the value of the smallest area its centre lies in."""
    lb, rb = g.box("l"), g.box("r")
    hit = banded(boxes, areas, keys, size, g.center_in(lb, rb))
    return hit.groupBy(*(F.col(f"l.{c}").alias(c) for c in boxes.columns)).agg(F.min_by(F.col(f"r.{value}"), F.struct(g.area(rb), F.col(f"r.{value}"))).alias(value))


def consensus(a: DataFrame, b: DataFrame, keys: list[str], plain: str) -> DataFrame:
    """JO5: two readers' picks (keys, id, x0, x1, and whether it is written like a price). Both picked it: kept. One did:
    kept if it is written like a price and shares width with one both picked. None in common on a page: the larger side."""
    x = a.select(*keys, "id", "x0", "x1", plain, F.lit(True).alias("in_a"))
    y = b.select(*keys, "id", "x0", "x1", plain, F.lit(True).alias("in_b"))
    both = x.join(y, [*keys, "id"], "full_outer").select(
        *keys, "id", *(F.coalesce(x[c], y[c]).alias(c) for c in ("x0", "x1", plain)), F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b")
    )
    w = Window.partitionBy(*keys)
    both = both.withColumn("agreed", F.col("in_a") & F.col("in_b"))
    count = lambda c: F.sum(F.col(c).cast("int")).over(w)
    both = both.withColumns({"_n": count("agreed"), "_a": count("in_a"), "_b": count("in_b")})
    # the agreed ones' intervals, merged by page: an interval that meets any of them is met by a neighbour of its start
    low = F.max(F.when(F.col("agreed"), F.col("x1"))).over(w.orderBy("x0").rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.min(F.when(F.col("agreed"), F.col("x0"))).over(w.orderBy("x0").rangeBetween(0, Window.unboundedFollowing))
    meets = F.coalesce(low > F.col("x0"), F.lit(False)) | F.coalesce(next_ < F.col("x1"), F.lit(False))
    keep = F.when(F.col("_n") > 0, F.col("agreed") | (F.col(plain) & meets)).otherwise(F.when(F.col("_a") >= F.col("_b"), F.col("in_a")).otherwise(F.col("in_b")))
    return both.withColumn("_k", keep).where("_k").select(*keys, "id", "agreed")


def jaccard_match(left: DataFrame, right: DataFrame, least: float, digits: int | None = None) -> DataFrame:
    """JO10, SE4: pairs of (id, words array) whose word sets have a Jaccard similarity of `least` or more (rounded to
    `digits`): by a common word of their prefixes (the rarest words of a set, as many as a match must meet one of), then
    exact counts. Equal sets are compared once, whatever ids have them. The ids of a set lie in blocks of some 256; pairs
    of blocks are dealt evenly and only then become pairs of ids, so that few sets with many ids use all cores."""

    def side(df):
        one = df.where("id is not null").select("id", F.explode("words").alias("w")).groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("set"))
        sets = one.groupBy("set").agg(F.count("*").alias("n"))
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 256)).alias("block")
        return sets, one.join(sets, "set").groupBy("set", block).agg(F.collect_list("id").alias("ids"))

    (a, a_blocks), (b, b_blocks) = side(left), side(right)
    words = a.select("n", F.explode("set").alias("w")).unionByName(b.select("n", F.explode("set").alias("w")))
    rank = words.groupBy("w").agg(F.sum("n").alias("n"))

    def prefixes(sets, name):
        one = sets.select("set", F.explode("set").alias("w")).join(rank, "w").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("s"))
        size = F.size("set")
        return one.select(F.col("set").alias(f"{name}_w"), F.explode(F.slice("s.w", F.lit(1), (size - F.ceil(size * least - 1e-9) + 1).cast("int"))).alias("w"))

    fit = (F.size("a_w") >= least * F.size("b_w") - 1e-9) & (F.size("b_w") >= least * F.size("a_w") - 1e-9)
    met = prefixes(a, "a").join(prefixes(b, "b"), "w").where(fit).dropDuplicates(["a_w", "b_w"]).withColumn("_c", F.size(F.array_intersect("a_w", "b_w")))
    out = met.withColumn("score", F.col("_c") / (F.size("a_w") + F.size("b_w") - F.col("_c"))).where(F.col("score") >= least - 1e-12)
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    names = lambda df, x: df.toDF(f"{x}_w", f"{x}_n", f"{x}_ids")
    out = out.select("a_w", "b_w", "score").join(names(a_blocks, "a"), "a_w").join(names(b_blocks, "b"), "b_w").repartition(parts, "a_w", "a_n", "b_w", "b_n")
    rows = out.select(F.explode("a_ids").alias("a"), "b_ids", "score").coalesce(parts)  # ends the code stage: the next holds 256 rows, not 65,536
    return rows.select("a", F.explode("b_ids").alias("b"), "score")


def _greedy_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One-to-one, each left row in order taking the nearest free right row; batches in order of pages and left rows."""
    page = left = object()  # unlike any
    used, free = set(), False
    for b in batches:
        rows = []
        for i, (p, l, r) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):  # noqa: E741
            if p != page:
                page, left, used, free = p, l, set(), True
            elif l != left:
                left, free = l, True
            if free and r not in used:
                used.add(r)
                rows.append(i)
                free = False
        yield b.take(pa.array(rows, pa.int64()))


def greedy_match(candidates: DataFrame) -> DataFrame:
    """JO6, JO9: candidates (page, left_id, left_ord, right_id, distance) matched one to one, greedily. Left rows come in
    order of left_ord, then of their nearest candidates; pages are read one after the other from sorted partitions, and
    only the right rows taken on one page are held."""
    first = F.min(F.struct("left_ord", "distance", "right_id")).over(Window.partitionBy("page", "left_id"))
    rows = candidates.where("left_id is not null").repartition("page").withColumn("_first", first).sortWithinPartitions("page", "_first", "left_id", "left_ord", "distance", "right_id")
    rows = rows.select("page", "left_id", "right_id", F.col("distance").cast("double").alias("distance"))
    return rows.mapInArrow(_greedy_pairs, rows.schema)


def _keep_complete(pdf: pd.DataFrame) -> pd.DataFrame:
    """The most complete reading first; each takes out those after it that overlap it, in one step of array operations."""
    p = pdf.sort_values(["digits", "conf", "width", "id"], ascending=[False, False, False, True])
    x0, y0, x1, y1 = (p[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
    area, free, kept = (x1 - x0) * (y1 - y0), np.ones(len(p), bool), []
    while free.any():
        k = int(free.argmax())
        both = np.clip(np.minimum(x1, x1[k]) - np.maximum(x0, x0[k]), 0, None) * np.clip(np.minimum(y1, y1[k]) - np.maximum(y0, y0[k]), 0, None)
        free &= both / np.maximum(np.minimum(area, area[k]), 1e-9) <= 0.3
        free[k] = False
        kept.append(k)
    return p.iloc[kept][["page", "id"]]


def dedupe_overlaps(boxes: DataFrame) -> DataFrame:
    """JO23: of boxes that overlap by over 30 %, the most complete reading stays; a page a group."""
    rows = boxes.withColumn("width", F.col("x1") - F.col("x0"))
    return rows.groupBy("page").applyInPandas(_keep_complete, f"page {boxes.schema['page'].dataType.simpleString()}, id {boxes.schema['id'].dataType.simpleString()}")


def alignment_costs(boxes: np.ndarray, words: np.ndarray, height: float) -> np.ndarray:
    """JO8: what it costs to take a word for a box (rows of x0, y0, x1, y1): the distance of their centres in heights, the
    difference of their widths and of their places across; over 2.5 heights apart never."""
    mid = lambda x, i: (x[:, i] + x[:, i + 2]) / 2
    width = np.maximum(1.0, boxes[:, 2] - boxes[:, 0])[:, None]
    dy = np.abs(mid(boxes, 1)[:, None] - mid(words, 1)) / height
    ratio = np.abs(np.log(np.maximum(1.0, words[:, 2] - words[:, 0]) / width))
    dx = np.abs(mid(boxes, 0)[:, None] - mid(words, 0)) / np.maximum(width, height)
    return np.where(dy > 2.5, np.inf, dy + 0.6 * np.minimum(ratio, 2.0) + 0.4 * np.minimum(dx, 3.0))


def align(costs: np.ndarray, unmatched: float = 3.0) -> list[int | None]:
    """JO8: for each row the column it is matched to, in order, at the least total cost; a row without one costs
    `unmatched`. A row at a time: what reaches a column is the least of leaving the row out, matching it there, and what
    reached the columns before it."""
    n, m = costs.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        best[i + 1] = best[i] + unmatched
        best[i + 1, 1:] = np.minimum(best[i + 1, 1:], best[i, :-1] + costs[i])
        best[i + 1] = np.minimum.accumulate(best[i + 1])
    out: list[int | None] = [None] * n
    j = m
    for i in range(n, 0, -1):
        j = int(np.searchsorted(-best[i, : j + 1], -best[i, j], "left"))  # the first column that does as well
        if best[i, j] < best[i - 1, j] + unmatched:
            out[i - 1], j = j - 1, j - 1
    return out


def align_columns(boxes: DataFrame, words: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """JO8: (col, box, word): boxes and words (col, id, x0, y0, x1, y1) of each column, matched in order of y; a column a
    group. heights: (col, h); without them a column's height is the median of its words'."""
    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.assign(yc=x.y0 + x.y1).sort_values(["yc", "id"]) for x in (a, b))
        box = lambda x: x[["x0", "y0", "x1", "y1"]].to_numpy(float)
        h = float(b.h.iloc[0]) if "h" in b and len(b) else float((b.y1 - b.y0).median()) if len(b) else 1.0
        found = align(alignment_costs(box(a), box(b), max(h, 1e-9)))
        ids = b.id.tolist()
        return pd.DataFrame({"col": key[0], "box": a.id.tolist(), "word": pd.array([None if j is None else ids[j] for j in found], "Int64")})

    words = words if heights is None else words.join(heights, "col")
    return boxes.groupBy("col").cogroup(words.groupBy("col")).applyInPandas(run, "col long, box long, word long")


#: JO9, JO11: how far lines may lie from each other, start and end apart, as shares of the grid; and how many must match.
POSITION, SPAN, ALIKE = 0.006, 0.025, 0.95


def line_candidates(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JO9: pairs of grid lines (keys, id, across, pos, start, end as shares) of two grids that may be the same line, in
    the form that greedy_match takes (the first key is its group)."""
    box = lambda x: x.withColumns({"y0": F.col("pos") * 1000, "y1": F.col("pos") * 1000})
    apart = lambda c: F.abs(F.col(f"l.{c}") - F.col(f"r.{c}"))
    on = (F.col("l.across") == F.col("r.across")) & (apart("pos") <= POSITION) & (apart("start") <= SPAN) & (apart("end") <= SPAN)
    hit = banded(box(a), box(b), keys, 10.0, on, pad=POSITION * 1000)
    return hit.select(F.col(f"l.{keys[0]}").alias("page"), F.col("l.id").alias("left_id"), F.col("l.pos").alias("left_ord"), F.col("r.id").alias("right_id"), apart("pos").alias("distance"))


def _in_order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of some ids, nulls first."""
    codes = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, codes + 1)


def _greedy_count(rows: list[tuple]) -> int:
    """How many left rows of a page get a right row: (left, right) in order, each left row's candidates together."""
    left, used, free = object(), set(), False
    for l, r in rows:  # noqa: E741
        if l != left:
            left, free = l, True
        if free and r not in used:
            used.add(r)
            free = False
    return len(used)


def _matched(t: pa.Table) -> pa.RecordBatch:
    """Of whole pages, in order of (page, side): each one's lines on both sides, and how many are paired."""
    key = t.column(0).combine_chunks()
    new = np.concatenate([[True], pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)])
    page, first = np.cumsum(new) - 1, np.flatnonzero(new)
    right = t.column("side").to_numpy() == 1
    n_a, n_b = (np.bincount(page[x], minlength=len(first)) for x in (~right, right))
    number, known = _in_order(t.column("id").combine_chunks()), ~t.column("across").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    across = t.column("across").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    pos, start, end = (t.column(c).to_numpy().astype(float) for c in ("pos", "start", "end"))  # nulls are NaN, and match nothing
    known &= ~np.isnan(pos)
    l, r = np.flatnonzero(~right & known & (number > 0)), np.flatnonzero(right & known)  # noqa: E741
    # the right lines that may be near enough: those between two ranks of the positions on the page, exact tests follow
    places = np.unique(pos[r])
    at = page[r] * (len(places) + 1) + np.searchsorted(places, pos[r])
    by = np.argsort(at, kind="stable")
    r, at = r[by], at[by]
    low, high = (page[l] * (len(places) + 1) + np.searchsorted(places, pos[l] + d, side) for d, side in ((-1.01 * POSITION, "left"), (1.01 * POSITION, "right")))
    low, high = np.searchsorted(at, low), np.searchsorted(at, high)
    n = high - low
    i = np.repeat(l, n)
    k = r[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    distance = np.abs(pos[i] - pos[k])
    near = (across[i] == across[k]) & (distance <= POSITION) & (np.abs(start[i] - start[k]) <= SPAN) & (np.abs(end[i] - end[k]) <= SPAN)
    i, k, distance = i[near], k[near], distance[near]
    # on pages whose lines have one candidate each all pairs stay; on the others they are chosen one after the other
    several = np.zeros(len(first), bool)
    for x in (i, k):
        order = np.lexsort((number[x], page[x]))
        p, m = page[x][order], number[x][order]
        several[p[1:][(p[1:] == p[:-1]) & (m[1:] == m[:-1])]] = True
    matched = np.bincount(page[i], minlength=len(first))
    hard = several[page[i]]
    i, k, distance = i[hard], k[hard], distance[hard]
    order = np.lexsort((number[k], distance, pos[i], number[i], page[i]))
    i, k, distance = i[order], k[order], distance[order]
    edge = np.ones(len(i), bool)
    edge[1:] = (page[i][1:] != page[i][:-1]) | (number[i][1:] != number[i][:-1])
    best = np.flatnonzero(edge)[np.cumsum(edge) - 1] if len(i) else i  # each left line's nearest candidate
    order = np.lexsort((np.arange(len(i)), number[i], number[k[best]], distance[best], pos[i[best]], page[i]))
    i, k = i[order], k[order]
    ends = np.flatnonzero(np.diff(page[i], prepend=-1))
    for a, b in zip(ends.tolist(), [*ends[1:].tolist(), len(i)], strict=True) if len(i) else ():
        matched[page[i[a]]] = _greedy_count(list(zip(number[i[a:b]].tolist(), number[k[a:b]].tolist(), strict=True)))
    both = np.flatnonzero((n_a > 0) & (n_b > 0))
    return pa.RecordBatch.from_arrays([key.take(pa.array(first[both])), *(pa.array(x[both].astype(np.int64)) for x in (n_a, n_b, matched))], names=["key", "_a", "_b", "matched"])


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of pages; a batch's last page waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0)
        cut = int(np.flatnonzero(np.concatenate([[True], pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)]))[-1])
        if cut or (held and held[-1].column(0)[0] != key[0]):
            if held or cut:
                yield _matched(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield _matched(pa.Table.from_batches(held))


def grid_likeness(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JO9, JO11: (key, matched, likeness, same): lines of two grids paired one to one, nearest first, as greedy_match pairs
    line_candidates; how many of the larger grid's lines have a partner, and whether that is enough for the same layout.
    Both grids' lines go by page to sorted partitions, once, and are paired there batch after batch, many pages at a time."""
    side = lambda x, n: x.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(n).alias("side"), "id", F.col("across").cast("boolean").alias("across"), *(F.col(c).cast("double").alias(c) for c in ("pos", "start", "end")))
    lines = side(a, 0).unionByName(side(b, 1)).repartition("key").sortWithinPartitions("key", "side")
    out = lines.mapInArrow(_likeness, f"key {lines.schema['key'].dataType.simpleString()}, _a long, _b long, matched long")
    share = F.col("matched") / F.greatest("_a", "_b")
    return out.select(F.col("key").alias(key), "matched", share.alias("likeness"), (share >= ALIKE).alias("same"))


def cascade(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """SE8, SE9: rows of the first source that has any for a key; each later one only for keys left over."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.join(out.select(*keys).distinct(), keys, "left_anti"))
    return out


def unseen(new: DataFrame, known: list[DataFrame], keys: list[str]) -> DataFrame:
    """SE5, ML18: new rows whose key none of the known tables has, each key once."""
    out = new.dropDuplicates(keys)
    for k in known:
        out = out.join(k.select(*keys), keys, "left_anti")
    return out


def within_page(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str], schema: str) -> DataFrame:
    """Order-dependent steps on small groups (a page, a document)."""
    return rows.groupBy(*keys).applyInPandas(f, schema)
