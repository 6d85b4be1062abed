"""The group finder: which lines of a list are titles of groups, and which group each price belongs to."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_kind, same_name, tight
from ..storage import cut
from .joins import banded

# Prior weights of the group model's features.
GROUP_PRIOR = {
    "bias": -3.2, "pos:inside": 1.6, "pos:above": 0.6, "pos:top": -2.2, "pos:below": -0.4, "pos:foot": -3.5, "hdr_next": 1.3, "hdr_prev": -0.8, "restart": 2.2, "rowno": -4.5,
    "near_price": -2.0, "ntok:1": 0.5, "ntok:2-3": 0.8, "ntok:4-6": 0.2, "ntok:7+": -1.2, "chunks:1": 1.6, "chunks:2": -0.6, "chunks:3+": -3.2, "align:center": 0.9, "align:start": 0.3,
    "align:end": -0.3, "wide": 0.2, "noletters": -3.5, "kw:group": 2.6, "kw:title": -2.2, "kw:note": -3.2, "kw:hdr": -1.6, "kw:hdr2": -3.8, "kw:date": -2.6, "kw:phone": -3.2, "kw:money": -1.2,
    "kw:unit": -0.8, "len:long": -1.8, "len:short": 0.3, "big": 0.8, "small": -0.6, "fill": 1.4, "fill:own": 1.0, "repeat": -2.6, "code": -1.8, "outside": -2.0, "in_col:text": -0.6,
    "in_col:num": -2.4, "span_cols": 0.6, "kw:company": -3.0, "num_cell": -3.0, "junk": -9.0, "src:ocr": -0.5, "ocr:long": -1.5, "ocr:bar": 1.0,
}
#: The group model's weights stay within this of their priors.
GROUP_LIMIT = 10.0


def title_features(lines: DataFrame, keys: list[str]) -> DataFrame:
    """ML4, FI17: (keys, id, f): the features of lines that may be titles.

    lines: keys (a page), id, text, x0, x1, y0, y1, h (the page's line height), n_prices, is_header, words (tokens),
    chunks (parts with wide gaps between), row_no (of a price line, or null). The page's price lines set its extent; a
    page without any gives no rows."""
    page, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("y0", "id")
    price = F.col("n_prices") > 0
    on_price = lambda c: F.when(price, c)
    l = lines.withColumns({  # noqa: E741
        "_top": F.min(on_price(F.col("y0"))).over(page), "_foot": F.max(on_price(F.col("y1"))).over(page), "_left": F.min(on_price(F.col("x0"))).over(page), "_right": F.max(on_price(F.col("x1"))).over(page),
        "_next_header": F.lead("is_header").over(down), "_last_header": F.lag("is_header").over(down),
        "_next_no": F.first(on_price(F.col("row_no")), ignorenulls=True).over(down.rowsBetween(1, Window.unboundedFollowing)), "_last_no": F.last(on_price(F.col("row_no")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)),
        "_above": F.last(on_price((F.col("y0") + F.col("y1")) / 2), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)), "_under": F.first(on_price((F.col("y0") + F.col("y1")) / 2), ignorenulls=True).over(down.rowsBetween(1, Window.unboundedFollowing)),
    })
    l = l.where("_top is not null").where(~price & ~F.col("is_header") & (F.length("text") >= 2))  # noqa: E741
    h, width, mid = F.col("h"), F.greatest(F.lit(1.0), F.col("_right") - F.col("_left")), (F.col("x0") + F.col("x1")) / 2
    yc = (F.col("y0") + F.col("y1")) / 2
    centre = (F.col("_left") + F.col("_right")) / 2
    where = F.when(yc.between(F.col("_top") - 0.2 * h, F.col("_foot") + 0.2 * h), "pos:inside").when((yc < F.col("_top")) & (F.col("_top") - F.col("y1") <= 7 * h), "pos:above").when(yc < F.col("_top"), "pos:top").when(F.col("y0") - F.col("_foot") <= 3 * h, "pos:below").otherwise("pos:foot")
    near = F.least(F.coalesce(yc - F.col("_above"), F.lit(1e9)), F.coalesce(F.col("_under") - yc, F.lit(1e9)))
    kind = line_kind(F.col("text"))
    flag = lambda c, name: F.when(c, F.lit(name))
    n = F.col("words")
    f = [
        F.lit("bias"), where, flag((F.col("x1") < F.col("_left") - 2) | (F.col("x0") > F.col("_right") + 2), "outside"), flag(F.col("_next_header"), "hdr_next"), flag(F.col("_last_header"), "hdr_prev"),
        flag((F.col("_next_no") < F.col("_last_no")), "restart"), flag(near < 0.8 * h, "near_price"),
        F.when(n == 1, "ntok:1").when(n <= 3, "ntok:2-3").when(n <= 6, "ntok:4-6").otherwise("ntok:7+"), F.when(F.col("chunks") <= 1, "chunks:1").when(F.col("chunks") == 2, "chunks:2").otherwise("chunks:3+"),
        F.when(F.abs(mid - centre) <= 0.12 * width, "align:center").when(mid > centre, "align:start").otherwise("align:end"), flag(F.col("x1") - F.col("x0") >= 0.5 * width, "wide"),
        flag(~F.col("text").rlike(r"\p{L}"), "noletters"), flag(kind["title"], "kw:title"), flag(kind["note"], "kw:note"), flag(kind["supplier"], "kw:company"),
        flag(F.col("text").rlike("(?U)^(گروه|سری|group)\\b"), "kw:group"), flag(F.col("text").rlike(r"^[A-Za-z0-9\-_/.]+$"), "code"),
        flag(F.length("text") > 45, "len:long"), flag(F.length("text") <= 14, "len:short"), flag(F.col("y1") - F.col("y0") >= 1.25 * h, "big"), flag(F.col("y1") - F.col("y0") <= 0.8 * h, "small"),
    ]
    return l.select(*keys, "id", F.array_compact(F.array(*f)).alias("f"))


def without_banners(titles: DataFrame, prices: DataFrame, doc: str, weight: float = GROUP_PRIOR["repeat"]) -> DataFrame:
    """ML5, AG12: titles whose name (key) is on 60 % of a document's pages with prices, three at least, lose probability by
    the weight of `repeat`."""
    pages = prices.groupBy(doc).agg(F.countDistinct("page").alias("_pages"))
    seen = titles.groupBy(doc, "key").agg(F.countDistinct("page").alias("_seen"))
    t = titles.join(seen, [doc, "key"]).join(pages, doc, "left")
    often = (F.col("_pages") >= 3) & (F.col("_seen") >= F.greatest(F.lit(3.0), 0.6 * F.col("_pages")))
    odds = F.log(F.col("p") / (1 - F.col("p"))) + weight
    return t.withColumn("p", F.when(often & F.col("p").between(1e-9, 1 - 1e-9), 1 / (1 + F.exp(-odds))).otherwise(F.col("p"))).drop("_pages", "_seen")


def outside_columns(titles: DataFrame, keys: list[str], size: float = 64.0) -> DataFrame:
    """ML5, JO19: bars within the rows of a group column that has the same name are lines of it, and go."""
    boxes = titles.withColumns({"y0": F.col("y"), "y1": F.coalesce(F.when(F.col("kind") == "column", F.coalesce("end", "y")), F.col("y"))})
    bars, columns = boxes.where("kind = 'bar'"), boxes.where("kind = 'column'")
    inside = F.col("l.y").between(F.col("r.y0"), F.col("r.y1")) & same_name(F.col("l.key"), F.col("r.key"))
    kept = banded(bars, columns.select(*keys, "key", "y0", "y1"), keys, size, inside, "left_anti")
    return kept.unionByName(columns).drop("y0", "y1")


def side_by_side(titles: DataFrame, keys: list[str], heights: float = 1.5) -> DataFrame:
    """ML5: bars at the same height (within 1.5 line heights) head tables side by side: each reaches to the middle of the
    gap to its neighbours; a bar by itself heads the whole width (from, to)."""
    bars = titles.where("kind = 'bar'")
    l, r = bars.alias("l"), bars.alias("r")
    same = F.abs(F.col("l.y") - F.col("r.y")) <= heights * F.col("l.h")
    for k in [*keys]:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    mid = lambda s: (F.col(f"{s}.x0") + F.col(f"{s}.x1")) / 2
    j = l.join(r, same & (F.col("l.tid") != F.col("r.tid")), "left")
    low = F.max(F.when(mid("r") < mid("l"), (F.col("r.x1") + F.col("l.x0")) / 2))
    high = F.min(F.when(mid("r") > mid("l"), (F.col("l.x1") + F.col("r.x0")) / 2))
    edge = j.groupBy(*(F.col(f"l.{k}").alias(k) for k in keys), F.col("l.tid").alias("tid")).agg(F.coalesce(low, F.lit(-1e9)).alias("from"), F.coalesce(high, F.lit(1e9)).alias("to"))
    return titles.join(edge, [*keys, "tid"], "left").withColumns({"from": F.coalesce("from", F.when(F.col("kind") == "column", F.lit(-1e9)).otherwise("x0")), "to": F.coalesce("to", F.when(F.col("kind") == "column", F.lit(1e9)).otherwise("x1"))})


@dataclass
class _Title:
    page: int
    y: float
    name: str
    column: bool
    end: float | None
    low: float
    high: float
    h: float


def _heads_a_price(t: _Title, later: list[_Title], spots: list[tuple[int, float]]) -> bool:
    """Whether a price stands under a title before the next one further down; a column title only heads its own rows."""
    after = next(((u.page, u.y) for u in later if u.page > t.page or u.y > t.y + 1.5 * t.h), (float("inf"), 0.0))
    for spot in spots[bisect_right(spots, (t.page, t.y)) :]:
        if spot > after:
            return False
        if not (t.column and t.end is not None and spot[0] == t.page and spot[1] > t.end):
            return True
    return False


def _bridge(titles: list[_Title], spots: list[tuple[int, float]]) -> None:
    """A column group cut by a page break has its end at one page's foot and its rest at the next one's top: both take the
    fuller of the two names."""
    pages = sorted({p for p, _ in spots})
    for a, b in zip(pages, pages[1:], strict=False):
        foot = max((t for t in titles if t.page == a and t.column and t.end is not None), key=lambda t: t.y, default=None)
        top = min((t for t in titles if t.page == b and t.column), key=lambda t: t.y, default=None)
        if foot is None or top is None or foot.end < max(y for p, y in spots if p == a) or top.y > min(y for p, y in spots if p == b):
            continue
        x, y = (n.replace(" ", "") for n in (foot.name, top.name))
        if x and y and (x in y or y in x):
            foot.name = top.name = max(foot.name, top.name, key=len)


def _tails(titles: list[_Title], spots: list[tuple[int, float]]) -> dict[int, tuple[float, str]]:
    """Rows under a page's last column group belong to a cell whose name stands on a later page: page -> (from which
    height on, that name or nothing)."""
    out: dict[int, tuple[float, str]] = {}
    waiting: list[int] = []
    for page in sorted({p for p, _ in spots}):
        columns = sorted((t for t in titles if t.page == page and t.column and t.end is not None), key=lambda t: t.y)
        heights = [y for p, y in spots if p == page]
        if not columns:
            if waiting and not any(t.page == page for t in titles):
                out[page] = (float("-inf"), "")
                waiting.append(page)
            else:
                waiting = []
            continue
        if waiting and columns[0].y <= min(heights):
            for q in waiting:
                out[q] = (out[q][0], columns[0].name)
        waiting = []
        if max(heights) > columns[-1].end + 1:
            out[page] = (columns[-1].end, "")
            waiting = [page]
    return out


def _name_at(titles: list[_Title], x: float, y: float, carried: str, tail: tuple[float, str] | None) -> str:
    """The group at a place of a page: a column group's rows first, then the page's tail, then the last bar above."""
    inside = next((t for t in titles if t.column and t.y - 1 <= y <= (float("inf") if t.end is None else t.end) + 1), None)
    if inside:
        return inside.name
    if tail and y > tail[0]:
        return tail[1]
    bars = [t for t in titles if not t.column and t.y <= y]
    best = next((t.name for t in reversed(bars) if t.low <= x <= t.high), carried)
    if not bars and any(t.column and t.end is not None and t.end < y for t in titles):
        return (tail[1] if tail else "") or best
    return best


def _find(prices: pd.DataFrame, titles: pd.DataFrame) -> list[str]:
    spots = sorted(zip(prices.page, prices.y, strict=True))
    found = sorted((_Title(r.page, r.y, r.name_, r.kind == "column", None if pd.isna(r.end) else r.end, r.low, r.high, r.h) for r in titles.itertuples()), key=lambda t: (t.page, t.y))
    found = [t for i, t in enumerate(found) if _heads_a_price(t, found[i + 1 :], spots)]
    _bridge(found, spots)
    tails = _tails(found, spots)
    carried, start = "", {}
    for page in sorted({p for p, _ in spots} | {t.page for t in found}):
        start[page] = carried
        own = [t for t in found if t.page == page]
        if page in tails and tails[page][1]:
            carried = tails[page][1]
        elif own:
            carried = max(own, key=lambda t: t.end if t.column and t.end is not None else t.y).name
    by_page = {p: [t for t in found if t.page == p] for p in start}
    return [_name_at(by_page[r.page], r.x, r.y, start[r.page], tails.get(r.page)) for r in prices.itertuples()]


def find_groups(prices: DataFrame, titles: DataFrame, doc: str = "doc", threshold: float = 0.5) -> DataFrame:
    """ML5: (doc, page, id, grp): the group of each price line.

    prices: doc, page, id, x and y (its centre). titles: doc, page, tid, name, key (its comparable form), p, kind (bar or
    column), y, x0, x1, end (of a column title: where its rows end, or null), h (line height). Banners on most pages lose
    probability; those that reach the threshold, outside a column group of the same name, are titles. Bars side by side
    part the width. Titles without a price before the next one go; names cut by a page break are made whole; rows under a
    page's last column group take the name on a later page; else a price has the last title above it, carried on from
    page to page. The last steps follow the order of a document, which is the group they run in."""
    t = without_banners(titles, prices, doc).where(F.col("p") >= threshold)
    t = side_by_side(cut(outside_columns(cut(t, "titles"), [doc, "page"]), "titles"), [doc, "page"])
    t = t.select(doc, "page", F.col("name").alias("name_"), "kind", "y", "end", F.col("from").alias("low"), F.col("to").alias("high"), "h")

    def run(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return p.assign(grp=_find(p, q))[[doc, "page", "id", "grp"]] if len(p) else pd.DataFrame({c: [] for c in (doc, "page", "id", "grp")})

    kinds = {f.name: f.dataType.simpleString() for f in prices.schema}
    return prices.groupBy(doc).cogroup(t.groupBy(doc)).applyInPandas(run, f"{doc} {kinds[doc]}, page {kinds['page']}, id {kinds['id']}, grp string")


def tidy_headers(columns: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """PR15: column names without the words of group titles; what is left unreadable or empty gets the column's number.
    columns: keys, col, header (array of words); titles: keys, word."""
    words = columns.select(*keys, "col", F.posexplode_outer("header").alias("pos", "word"))
    kept = words.join(titles.select(*keys, "word").distinct(), [*keys, "word"], "left_anti")
    said = kept.groupBy(*keys, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("name"))
    out = columns.select(*keys, "col").distinct().join(said, [*keys, "col"], "left")
    good = F.coalesce(F.col("name").rlike(r"\p{L}|\d"), F.lit(False)) & ~F.col("name").rlike("[�-]")
    return out.select(*keys, "col", F.when(good, F.col("name")).otherwise(F.concat(F.lit("column "), F.col("col").cast("string"))).alias("name"))


def is_same_group(a: Column, b: Column) -> Column:
    """ML16: a teacher's name and a line's, for lessons: the same when tight."""
    return tight(a) == tight(b)
