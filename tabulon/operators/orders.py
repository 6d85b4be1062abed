"""Orders, ids and small rules of a page: reading order, stable ids, price texts, notes, bounds, bridges, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of, banded


def _joined(values: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(values), lambda s: s[field]), sep)


def reading_order(keys: list[str], ties: str = "id") -> Column:
    """SO1: a box's place on its page, from 1: from the top, then from the right."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy("y0", F.col("x1").desc(), ties))


def layout_order(keys: list[str], table_width: float, row_height: float, ties: list[str]) -> Column:
    """SO2: a box's place, from 1: table by table from the right, row by row, from the right."""
    w = Window.partitionBy(*keys).orderBy(F.floor(F.col("x0") / table_width).desc(), F.round(F.col("y0") / row_height), F.col("x1").desc(), *ties)
    return F.row_number().over(w)


def stable_ids(boxes: DataFrame, page: str = "page", kinds: list[str] = ("price",)) -> DataFrame:
    """PR13: `item`: p{page}-{n}, n in reading order, kind after kind (in the order of `kinds`) and going on from one to the
    next. boxes: page, kind, id, y0, x1; kinds not named come last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    w = Window.partitionBy(page).orderBy(F.when(rank == 0, len(kinds) + 1).otherwise(rank), "y0", F.col("x1").desc(), "id")
    return boxes.withColumn("item", F.concat(F.lit("p"), F.col(page).cast("string"), F.lit("-"), F.row_number().over(w).cast("string")))


def price_texts(cells: DataFrame, keys: list[str], order: list[str], value: str, words: str | None = None) -> DataFrame:
    """PR9: (keys, text): a cell's new values with ` / ` between, in order, then the words left over in it."""
    parts = [F.collect_list(F.struct(*order, F.col(value).alias("_v"))).alias("_vs")]
    if words:
        parts.append(F.max(words).alias("_words"))
    g = cells.where(F.col(value).isNotNull() if not words else F.lit(True)).groupBy(*keys).agg(*parts)
    text = _joined(F.filter("_vs", lambda s: s["_v"].isNotNull()), "_v", " / ")
    left = F.coalesce(F.concat(F.lit(" "), F.when(F.trim("_words") != "", F.trim("_words"))), F.lit("")) if words else F.lit("")
    return g.select(*keys, F.trim(F.concat(text, left)).alias("text"))


def notes(rows: DataFrame, keys: list[str], note: str, most: int | None = None) -> DataFrame:
    """PR12, SO5: (keys, notes): each key's distinct notes in their order, the first `most` of them, as one text."""
    all_ = F.array_sort(F.collect_set(note))
    return rows.groupBy(*keys).agg(F.array_join(F.slice(all_, 1, most) if most else all_, ", ").alias("notes"))


def top_for_report(rows: DataFrame, key: str, most: int) -> DataFrame:
    """SO5: the `most` most frequent keys, ties by the key: one top-n, not a sort."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(most)


def fingerprint(outline: Column) -> Column:
    """JO14: the first 16 hex digits of the outline's md5."""
    return F.substring(F.md5(outline.cast("binary")), 1, 16)


def named_outlines(glyphs: DataFrame, memory: DataFrame, outline: str, name: str) -> DataFrame:
    """JO14: glyphs with the name that the outline memory has for theirs, null where it has none; of several the least."""
    known = memory.groupBy(fingerprint(F.col(outline)).alias("_k")).agg(F.min(name).alias(name))
    return glyphs.withColumn("_k", fingerprint(F.col(outline))).join(known, "_k", "left").drop("_k")


def same_cells(a: DataFrame, b: DataFrame, key: str, at: str, tolerance: float) -> DataFrame:
    """JO16: (key, same): whether two records have the same cells: as many, and in the order of their positions each within
    the tolerance of its partner, which on a line is the best a one-to-one match of the multisets can do."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(at))
    side = lambda x, name: x.select(key, F.col(at).alias(name), place.alias("_n"))
    both = side(a, "_a").join(side(b, "_b"), [key, "_n"], "full_outer")
    near = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
    # only records that both have
    seen = both.groupBy(key).agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.bool_and(near).alias("same"))
    return seen.where("_na > 0 and _nb > 0").select(key, "same")


def page_points(boxes: DataFrame, pages: DataFrame, keys: list[str], zoom: str, columns: list[str]) -> DataFrame:
    """JO25: raster boxes in page points: each coordinate divided by its page's zoom."""
    j = boxes.join(pages.select(*keys, F.col(zoom).alias("_zoom")), keys)
    return j.withColumns({c: F.col(c) / F.col("_zoom") for c in columns}).drop("_zoom")


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """AG18: how often each word comes."""
    return texts.select(F.explode(F.split(text, " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def count_maps(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """AR6: (keys, counts): a map of each item's count, items in order."""
    n = rows.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(item, "_n")))).alias("counts"))


def goes_on(name: str, keys: list[str], order: list[str]) -> Column:
    """WI13: whether the next part's name is this one's, or one holds the other (a name cut by a page break)."""
    after = F.lead(name).over(Window.partitionBy(*keys).orderBy(*order))
    return (after == F.col(name)) | ((F.length(name) > 0) & (F.length(after) > 0) & (F.contains(after, F.col(name)) | F.contains(F.col(name), after)))


def fuller_name(name: str, keys: list[str], order: list[str]) -> Column:
    """WI13: the longer of two names where one part goes on in the next; else its own."""
    after = F.lead(name).over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(F.coalesce(goes_on(name, keys, order), F.lit(False)) & (F.length(after) > F.length(name)), after).otherwise(F.col(name))


def ranks(keys: list[str], by: str, ties: str, parts: int = 4) -> dict[str, Column]:
    """WI15: rank, dense rank, percent rank by a value, and its part of `parts` (ties parted by `ties`)."""
    w = Window.partitionBy(*keys).orderBy(by)
    return {"r": F.rank().over(w), "dr": F.dense_rank().over(w), "q": F.ntile(parts).over(Window.partitionBy(*keys).orderBy(by, ties)), "pr": F.percent_rank().over(w)}


def titles_with_prices(lines: DataFrame, keys: list[str], order: list[str], title: str, price: str, tid: str) -> DataFrame:
    """WI17: (id of a title, prices): how many prices stand between it and the next title; titles without any go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("_seg", F.sum(F.col(title).cast("int")).over(w)).where("_seg > 0")
    g = s.groupBy(*keys, "_seg").agg(F.min(F.when(F.col(title), F.col(tid))).alias(tid), F.count_if(price).alias("prices"))
    return g.where("prices > 0").select(tid, "prices")


def scale_fit(points: DataFrame, keys: list[str], x: str, y: str, reject: float | None = 3.0, least: int = 2) -> DataFrame:
    """MA10: (keys, slope, n): the least-squares slope of y over x; with `reject`, fitted once more without the points
    whose residual is more than that many times the median one. Keys with fewer than `least` different x give none."""
    def fit(p: DataFrame) -> DataFrame:
        g = p.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("_at"), F.count("*").alias("n"), F.count_distinct(x).alias("_k"))
        return g.where(F.col("_k") >= least).drop("_k")

    first = fit(points)
    if reject is None:
        return first.drop("_at")
    off = points.join(first, keys).withColumn("_off", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("_at")))
    off = off.withColumn("_mid", F.percentile("_off", 0.5).over(Window.partitionBy(*keys))).where(F.col("_off") <= F.greatest(reject * F.col("_mid"), F.lit(1e-9)))
    return fit(off.select(*points.columns)).drop("_at")


def free_bounds(boxes: DataFrame, others: DataFrame, keys: list[str], size: float) -> DataFrame:
    """AG15: how far a box can grow to the left and right: the largest right edge left of it and the least left edge right
    of it among boxes of its row; null: nothing stands there. boxes: keys, id, x0..y1."""
    hit = banded(boxes, others, keys, size, F.least("l.y1", "r.y1") >= F.greatest("l.y0", "r.y0"))
    left = F.max(F.when(F.col("r.x1") <= F.col("l.x0"), F.col("r.x1")))
    right = F.min(F.when(F.col("r.x0") >= F.col("l.x1"), F.col("r.x0")))
    return hit.groupBy(*(F.col(f"l.{c}").alias(c) for c in (*keys, "id", "y0"))).agg(left.alias("left_bound"), right.alias("right_bound"))


def photo_route(known: Column, unsure: Column, n: Column) -> Column:
    """ML15: who reads a photo page: a known list; the local reader, if it is unsure of a tenth (one at least); a teacher."""
    return F.when(known, "known").when(unsure <= F.greatest(F.lit(1), 0.1 * n), "local").otherwise("teacher")


def group_lessons(lines: DataFrame, checked: DataFrame, keys: list[str], at: str, value: str, right: Column) -> DataFrame:
    """ML16: lessons of a page's lines: each with the last checked value before it (lines without one give none), and
    whether it is right."""
    return as_of(lines, checked, keys, at, [value]).where(F.col(value).isNotNull()).withColumn("y", right)


def number_runs(glyphs: DataFrame, keys: list[str], order: str = "x0", share: float = 0.6) -> DataFrame:
    """SC20: (keys, first, text): numbers of a line's glyphs (text, x0, x1, size): runs of digits and separators, begun by a
    digit; a gap over 0.6 of the size, or any other sign, ends one; separators at its end go."""
    w = Window.partitionBy(*keys).orderBy(order)
    digit = F.col("text").rlike("^[0-9۰-۹٠-٩]$")
    inside = digit | F.col("text").rlike("^[,٬،/.'’٫]$")
    g = glyphs.withColumn("_in", inside).withColumn("_digit", digit)
    apart = ~F.coalesce(F.lag("_in").over(w), F.lit(False)) | (F.col("x0") - F.lag("x1").over(w) > share * F.col("size"))
    g = g.withColumn("_run", F.sum(F.when(F.col("_in") & ~apart, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    # separators before the first digit aren't part of it
    g = g.withColumn("_from", F.min(F.when(F.col("_digit"), F.col(order))).over(Window.partitionBy(*keys, "_run"))).where(F.col(order) >= F.col("_from"))
    out = g.groupBy(*keys, "_run").agg(F.min(order).alias("first"), _joined(F.collect_list(F.struct(order, "text")), "text", "").alias("text"))
    return out.select(*keys, "first", F.regexp_replace("text", "[^0-9۰-۹٠-٩]+$", "").alias("text"))


def coverage_columns(words: DataFrame, keys: list[str], bin_width: float, share: float = 0.0) -> DataFrame:
    """SC22: (keys, col, x0, x1): columns of a list without rules: bins across that words of more than `share` of the rows
    cover; neighbouring covered bins make a column. words: keys, row, x0, x1."""
    total = words.groupBy(*keys).agg(F.count_distinct("row").alias("_rows"))
    bins = words.select(*keys, "row", F.explode(F.sequence(F.floor(F.col("x0") / bin_width).cast("long"), F.greatest(F.floor(F.col("x0") / bin_width), F.ceil(F.col("x1") / bin_width) - 1).cast("long"))).alias("_b"))
    covered = bins.groupBy(*keys, "_b").agg(F.count_distinct("row").alias("_n")).join(total, keys).where(F.col("_n") > share * F.col("_rows"))
    w = Window.partitionBy(*keys).orderBy("_b")
    new = F.when(F.lag("_b").over(w) == F.col("_b") - 1, 0).otherwise(1)
    c = covered.withColumn("_new", new).withColumn("col", F.sum("_new").over(w))
    return c.groupBy(*keys, "col").agg((F.min("_b") * bin_width).alias("x0"), ((F.max("_b") + 1) * bin_width).alias("x1"))
