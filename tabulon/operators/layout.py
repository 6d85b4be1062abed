"""Pages: labels, headers, titles, line features, the group finder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import as_of, banded


def row_labels(words: DataFrame, keys: list[str], row_no: str | None = None, most: int = 10) -> DataFrame:
    """PR4: a row's words from the right, ten at most, after its number."""
    a = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("x1")).alias("k"), "text"))).alias("w"), *([F.max(row_no).alias("no")] if row_no else []))
    text = F.array_join(F.transform(F.slice("w", 1, most), lambda s: s["text"]), " ")
    return a.select(*keys, (F.concat(F.coalesce(F.concat(F.col("no").cast("string"), F.lit(" - ")), F.lit("")), text) if row_no else text).alias("label"))


def headers(words: DataFrame, columns: DataFrame, keys: list[str], height: float, size: float = 32.0) -> DataFrame:
    """JO20, PR5: of each column (col, x0, x1, y0: its top) the words above it within nine line heights that share 30 % of
    the narrower width, of the nearest band (2.6 heights), eight at most, from the right."""
    area = columns.withColumns({"y1": F.col("y0"), "top": F.col("y0")}).withColumn("y0", F.col("y0") - 9 * height)
    l, r = g.box("l"), g.box("r")  # noqa: E741
    wide = g.overlap(l[0], l[2], r[0], r[2]) >= 0.3 * F.least(l[2] - l[0], r[2] - r[0])
    hit = banded(words, area, keys, size, wide & (F.col("l.y1") <= F.col("r.top")) & (F.col("l.y1") >= F.col("r.y0")))
    hit = hit.select(*(F.col(f"l.{k}").alias(k) for k in keys), F.col("r.col").alias("col"), F.col("l.text").alias("text"), F.col("l.x1").alias("x1"), F.col("l.y1").alias("y1"))
    near = hit.withColumn("_m", F.max("y1").over(Window.partitionBy(*keys, "col"))).where(F.col("y1") >= F.col("_m") - 2.6 * height)
    return row_labels(near, [*keys, "col"], most=8).withColumnRenamed("label", "header")


def page_title(words: DataFrame, keys: list[str], tolerance: float, most: int = 60) -> DataFrame:
    """PR6: the first line of text, 60 characters of it."""
    top = F.min("y0").over(Window.partitionBy(*keys))
    return row_labels(words.withColumn("_t", top).where(F.col("y0") <= F.col("_t") + tolerance), keys, most=100).select(*keys, F.substring("label", 1, most).alias("title"))


def labels_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """PR7: of a table's row the first cell of 1 to 4 digits and the longest with letters."""
    number = F.min(F.when(F.trim("text").rlike("^[0-9]{1,4}$"), F.struct("col", F.trim("text").alias("t"))))["t"]
    name = F.max(F.when(F.col("text").rlike(r"\p{L}"), F.struct(F.length("text").alias("n"), (-F.col("col")).alias("c"), "text")))["text"]
    return cells.groupBy(*keys).agg(number.alias("no"), name.alias("name"))


def glued(keys: list[str], order: str = "x0", share: float = 0.12, letter: Column | None = None) -> Column:
    """FI3: a letter stands closer than 0.12 of the size, on either side."""
    w = Window.partitionBy(*keys).orderBy(order)
    is_letter = letter if letter is not None else F.col("text").rlike(r"\p{L}")
    before = F.lag(is_letter).over(w) & (F.col("x0") - F.lag("x1").over(w) < share * F.col("size"))
    after = F.lead(is_letter).over(w) & (F.lead("x0").over(w) - F.col("x1") < share * F.col("size"))
    return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))


def fragments(numbers: DataFrame, ink: DataFrame, keys: list[str], size: float) -> DataFrame:
    """FI11: numbers with no ink beside them on the line closer than 0.45 of their height: complete ones (an anti-join)."""
    l, r = g.box("l"), g.box("r")  # noqa: E741
    high = l[3] - l[1]
    gap = F.greatest(r[0] - l[2], l[0] - r[2])
    beside = (g.overlap(l[1], l[3], r[1], r[3]) > 0.5 * high) & (gap >= 0) & (gap < 0.45 * high)
    return banded(numbers, ink, keys, size, beside, "left_anti")


def good_page(placed: Column, prices: Column, n_headers: Column, in_text: Column) -> Column:
    """FI13: every price placed, two headers at least, no price in a long text cell."""
    return (placed == prices) & (n_headers >= 2) & (in_text == 0)


def number_like(width: Column, height: Column, price_height: Column, inside: Column) -> Column:
    """FI16: ink of 0.6 to 1.7 price heights, 0.8 wide at least, inside its cell."""
    return inside & (height >= 0.6 * price_height) & (height <= 1.7 * price_height) & (width >= 0.8 * price_height)


def line_features(keys: list[str], order: str) -> dict[str, Column]:
    """FI17, AR1: which features a line (text, x0, x1, width: the page's) has."""
    w = Window.partitionBy(*keys).orderBy(order)
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return {
        "top": F.row_number().over(w) == 1, "foot": F.lead(order).over(w).isNull(), "len:short": words <= 3, "len:long": words > 10,
        "wide": F.col("x1") - F.col("x0") > 0.6 * F.col("width"), "noletters": ~F.col("text").rlike(r"\p{L}"), "code": F.col("text").rlike(r"^[A-Za-z0-9\-_/.]+$"),
        "centre": F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) < 0.05 * F.col("width"),
    }


def feature_array(features: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in features.items())))


def column_ranks(keys: list[str], x0: str = "x0", x1: str = "x1") -> tuple[Column, Column]:
    """AG10: a column's place from the left and from the right."""
    w = Window.partitionBy(*keys)
    return F.row_number().over(w.orderBy(x0, x1)), F.row_number().over(w.orderBy(F.col(x1).desc(), F.col(x0).desc()))


def column_features(nums: DataFrame, keys: list[str]) -> DataFrame:
    """AG10, ML2: of a column: how many numbers are grouped, are of one length, end in 000."""
    n = F.count("*")
    return nums.groupBy(*keys).agg(
        n.alias("n"), (F.count_if(F.col("sep") != "") / n).alias("grouped"), (F.count_distinct(F.length("digits")) == 1).alias("same_length"), (F.count_if(F.endswith("digits", F.lit("000"))) / n).alias("thousands")
    )


def group_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """AG13: columns of tall cells (1.8 rows a cell at least) that cover half of the item rows and hold no price."""
    rows = cells.groupBy(*keys).agg(F.max("r1").alias("_rows"))
    c = cells.groupBy(*keys, "col").agg(F.sum(F.col("r1") - F.col("r0")).alias("covered"), F.count("*").alias("cells"), F.count_if("has_price").alias("prices"))
    return c.join(rows, keys).where((F.col("prices") == 0) & (F.col("covered") >= 0.5 * F.col("_rows")) & (F.col("covered") >= 1.8 * F.col("cells"))).select(*keys, "col", "covered")


def mean_shape(shapes: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """AG23: element by element the median of the shapes of a key."""
    e = shapes.select(*keys, F.posexplode(vec).alias("pos", "v")).groupBy(*keys, "pos").agg(F.percentile("v", 0.5).alias("m"))
    return e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("shape"))


def settle_group(items: DataFrame, names: DataFrame, doc: str, same) -> DataFrame:
    """JO26: the taught group of an item (doc, page, taught) if the last name on this or an earlier page is the same by
    `same`, else the item's own."""
    seen = as_of(items, names, [doc], "page", ["name"])
    return seen.withColumn("settled", F.when(F.coalesce(same(F.col("taught"), F.col("name")), F.lit(False)), F.col("name")).otherwise(F.col("mine")))


def not_in_titles(words: DataFrame, titles: DataFrame, keys: list[str], size: float) -> DataFrame:
    """JO19, JO27, PR15: words whose centre no title box holds."""
    return banded(words, titles, keys, size, g.center_in(g.box("l"), g.box("r")), "left_anti")
