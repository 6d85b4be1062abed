"""Joins by place, time and likeness; clusters; votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import aggregates, joins, orders
from ..registry import query
from .base import BOXES, boxes, table, wide_pages

_A, _B = f"(SELECT * FROM {BOXES} WHERE flag = 'A')", f"(SELECT * FROM {BOXES} WHERE flag <> 'A')"


def _sides(spark, d):
    b = boxes(spark, d)
    return b.where("flag = 'A'"), b.where("flag <> 'A'")


_IX = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"
_IOU = f"({_IX}) / (64.0 - ({_IX}))"


@query("jo1_price_in_cell", f"""SELECT page, l_id, r_id FROM (SELECT l.page, l.id AS l_id, l.y0 AS ly, r.id AS r_id, row_number() OVER (PARTITION BY l.page, l.id, l.y0, l.x0 ORDER BY r.id, r.y0) AS k
FROM (SELECT DISTINCT * FROM {_A}) l JOIN (SELECT DISTINCT page, id, x0 - 12 AS x0, y0 - 4 AS y0, x1 + 12 AS x1, y1 + 4 AS y1 FROM {_B}) r ON l.page = r.page AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1) WHERE k = 1""")
def jo1(spark, d):
    a, b = _sides(spark, d)
    cells = b.select("page", "id", (F.col("x0") - 12).alias("x0"), (F.col("y0") - 4).alias("y0"), (F.col("x1") + 12).alias("x1"), (F.col("y1") + 4).alias("y1")).distinct()
    hit = joins.banded(a.distinct(), cells, ["page"], 16.0, g.center_in(g.box("l"), g.box("r")))
    hit = hit.select(*(F.col(f"l.{c}").alias(c) for c in ("page", "id", "y0", "x0")), F.col("r.id").alias("r_id"), F.col("r.y0").alias("ry"))
    return joins.best_by(hit, ["page", "id", "y0", "x0"], -F.col("r_id"), [F.col("ry")]).select("page", F.col("id").alias("l_id"), "r_id")


@query("jo2_nearest_line", "SELECT e.event_id, a.value AS line FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) a ON e.user_id = a.user_id AND e.ts >= a.ts")
def jo2(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    lines = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("line"))
    return joins.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), lines, ["user_id"], "ts", ["line"]).select("event_id", "line")


@query("jo3_title_above", f"""SELECT i.page, i.id, i.y0, t.id AS title FROM (SELECT * FROM {_B}) i ASOF LEFT JOIN (SELECT page, y0, max(id) AS id FROM {_A} GROUP BY page, y0) t ON i.page = t.page AND i.y0 > t.y0""")
def jo3(spark, d):
    a, b = _sides(spark, d)
    titles = a.groupBy("page", "y0").agg(F.max("id").alias("title"))
    return joins.as_of(b, titles, ["page"], "y0", ["title"], strict=True).select("page", "id", "y0", "title")


@query("jo4_truth_boxes", f"""SELECT DISTINCT l.page, l.id, l.y0 FROM {_A} l WHERE EXISTS (SELECT 1 FROM {_B} r WHERE l.page = r.page AND ({_IOU} >= 0.05 OR ((l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1)))""")
def jo4(spark, d):
    a, b = _sides(spark, d)
    on = (g.iou(g.box("l"), g.box("r")) >= 0.05) | g.center_in(g.box("l"), g.box("r"))
    return joins.banded(a, b, ["page"], 8.0, on, "left_semi").select("page", "id", "y0").distinct()


@query("jo7_best_overlap", f"""SELECT page, id, y0, arg_max(rid, o) AS reading FROM (SELECT l.page, l.id, l.y0, r.id AS rid, {_IOU} * 1000000 - r.id AS o FROM (SELECT DISTINCT * FROM {_A}) l JOIN (SELECT DISTINCT * FROM {_B}) r ON l.page = r.page WHERE {_IOU} > 0.1) GROUP BY page, id, y0""")
def jo7(spark, d):
    a, b = _sides(spark, d)
    score = g.iou(g.box("l"), g.box("r"))
    hit = joins.banded(a.distinct(), b.distinct(), ["page"], 8.0, score > 0.1).select(*(F.col(f"l.{c}").alias(c) for c in ("page", "id", "y0")), F.col("r.id").alias("rid"), (score * 1000000 - F.col("r.id")).alias("o"))
    return hit.groupBy("page", "id", "y0").agg(F.max_by("rid", "o").alias("reading"))


@query("jo17_unknown_numbers", f"""SELECT DISTINCT l.page, l.id, l.y0 FROM {_A} l WHERE NOT EXISTS (SELECT 1 FROM {_B} r WHERE l.page = r.page AND abs(l.x0 - r.x0) <= 10 AND abs(l.y0 - r.y0) <= 6)""")
def jo17(spark, d):
    a, b = _sides(spark, d)
    near = (F.abs(F.col("l.x0") - F.col("r.x0")) <= 10) & (F.abs(F.col("l.y0") - F.col("r.y0")) <= 6)
    return joins.banded(a.select("page", "id", "x0", "y0", "x1", "y1").distinct(), b, ["page"], 16.0, near, "left_anti", pad=6.0).select("page", "id", "y0")


@query("jo22_same_row", f"""SELECT l.page, l.id AS a, r.id AS b, l.y0 AS ya, r.y0 AS yb FROM (SELECT DISTINCT * FROM {BOXES}) l JOIN (SELECT DISTINCT * FROM {BOXES}) r ON l.page = r.page AND l.x0 < r.x0 AND least(l.y1, r.y1) - greatest(l.y0, r.y0) >= 0.45 * 4""")
def jo22(spark, d):
    b = boxes(spark, d).distinct()
    on = (F.col("l.x0") < F.col("r.x0")) & (g.overlap(F.col("l.y0"), F.col("l.y1"), F.col("r.y0"), F.col("r.y1")) >= 0.45 * 4)
    return joins.banded(b, b, ["page"], 8.0, on).select(F.col("l.page").alias("page"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.y0").alias("ya"), F.col("r.y0").alias("yb"))


@query("jo24_smallest_area", f"""SELECT l.page, l.id, l.y0, min(r.id) AS colour FROM (SELECT DISTINCT * FROM {_A}) l JOIN (SELECT DISTINCT page, id, x0 - 20 AS x0, y0 - 10 AS y0, x1 + 20 AS x1, y1 + 10 AS y1 FROM {_B}) r
ON l.page = r.page AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY l.page, l.id, l.y0""")
def jo24(spark, d):
    a, b = _sides(spark, d)
    areas = b.select("page", "id", (F.col("x0") - 20).alias("x0"), (F.col("y0") - 10).alias("y0"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 10).alias("y1"), F.col("id").alias("colour")).distinct()
    out = joins.smallest_container(a.select("page", "id", "x0", "y0", "x1", "y1").distinct(), areas, ["page"], 16.0, "colour")
    return out.groupBy("page", "id", "y0").agg(F.min("colour").alias("colour"))


@query("jo5_consensus", """WITH a AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS id, l_quantity AS x0, l_quantity + 4 AS x1, l_partkey % 2 = 0 AS p FROM lineitem WHERE l_linenumber < 4),
b AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS id, l_quantity AS x0, l_quantity + 4 AS x1, l_partkey % 2 = 0 AS p FROM lineitem WHERE l_linenumber > 1),
u AS (SELECT page, id, coalesce(min(x0) FILTER (WHERE s = 0), min(x0)) AS x0, coalesce(min(x1) FILTER (WHERE s = 0), min(x1)) AS x1, bool_or(p) AS p, bool_or(s = 0) AS ina, bool_or(s = 1) AS inb FROM (SELECT *, 0 AS s FROM (SELECT page, id, min(x0) AS x0, min(x1) AS x1, bool_or(p) AS p FROM a GROUP BY page, id) UNION ALL SELECT *, 1 FROM (SELECT page, id, min(x0) AS x0, min(x1) AS x1, bool_or(p) AS p FROM b GROUP BY page, id)) GROUP BY page, id),
c AS (SELECT *, ina AND inb AS agreed, count(*) FILTER (WHERE ina AND inb) OVER (PARTITION BY page) AS n, count(*) FILTER (WHERE ina) OVER (PARTITION BY page) AS na, count(*) FILTER (WHERE inb) OVER (PARTITION BY page) AS nb FROM u)
SELECT page, id, agreed FROM c WHERE CASE WHEN n > 0 THEN agreed OR (p AND EXISTS (SELECT 1 FROM c r WHERE r.page = c.page AND r.agreed AND least(c.x1, r.x1) > greatest(c.x0, r.x0))) WHEN na >= nb THEN ina ELSE inb END""")
def jo5(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    pick = lambda c: l.where(c).groupBy(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("x0"), F.min(F.col("l_quantity") + 4).alias("x1"), F.bool_or(F.col("l_partkey") % 2 == 0).alias("plain"))
    return joins.consensus(pick("l_linenumber < 4"), pick("l_linenumber > 1"), ["page"], "plain")


@query("jo10_known_formats", """WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS w FROM part), n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w a JOIN w b ON a.w = b.w GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS score FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.5""")
def jo10(spark, d):
    w = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    return joins.jaccard_match(w, w, 0.5, digits=6)


@query("jo14_outline_memory", "SELECT a.p_partkey, b.name FROM (SELECT p_partkey, substr(md5(p_type), 1, 16) AS k FROM part) a LEFT JOIN (SELECT substr(md5(p_type), 1, 16) AS k, min(p_type) AS name FROM part WHERE p_size > 45 GROUP BY 1) b USING (k)")
def jo14(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    return orders.named_outlines(p.drop("p_size"), p.where("p_size > 45").select("p_type", F.col("p_type").alias("name")), "p_type", "name").select("p_partkey", "name")


@query("jo18_not_placed", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def jo18(spark, d):
    placed = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.unseen(table(spark, d, "part").select("p_partkey"), [placed], ["p_partkey"])


@query("jo25_page_points", "SELECT l.l_orderkey, l.l_linenumber, round(l.l_quantity / (o.o_orderkey % 3 + 1), 6) AS x FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def jo25(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 + 1).alias("zoom"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))  # noqa: E741
    return orders.page_points(l, o, ["l_orderkey"], "zoom", ["x"]).withColumn("x", F.round("x", 6))


@query("jo21_subheader_above", """WITH h AS (SELECT conv_id, turn, substr(text, 1, 20) AS header FROM conversations WHERE role = 'user')
SELECT c.conv_id, c.turn, h.header FROM (SELECT * FROM conversations WHERE role <> 'user') c ASOF LEFT JOIN (SELECT conv_id, turn, max(header) AS header FROM h GROUP BY ALL) h ON c.conv_id = h.conv_id AND c.turn > h.turn""")
def jo21(spark, d):
    c = table(spark, d, "conversations")
    heads = c.where("role = 'user'").groupBy("conv_id", "turn").agg(F.max(F.substring("text", 1, 20)).alias("header"))
    return joins.as_of(c.where("role <> 'user'").select("conv_id", "turn"), heads, ["conv_id"], "turn", ["header"], strict=True)


@query("jo6_greedy_match")
def jo6(spark, d):
    b = wide_pages(boxes(spark, d))
    a, b = b.where("flag = 'A'"), b.where("flag <> 'A'")
    on = (F.abs(F.col("l.y0") - F.col("r.y0")) <= 4) & (F.abs(F.col("l.x0") - F.col("r.x0")) <= 20)
    c = joins.banded(a, b, ["page"], 8.0, on, pad=4.0)
    c = c.select(F.col("l.page").alias("page"), F.col("l.id").alias("left_id"), F.col("l.id").alias("left_ord"), F.col("r.id").alias("right_id"), F.abs(F.col("l.y0") - F.col("r.y0")).alias("distance"))
    return joins.greedy_match(c)


@query("jo8_align")
def jo8(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    x, y = F.col("l_linenumber") % 2 * 3.0, F.col("l_quantity")
    side = lambda c: l.where(c).select(F.floor(F.col("l_orderkey") / 16).alias("col"), F.col("l_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 8 + F.col("l_tax") * 100).alias("x1"), (y + 4).alias("y1"))
    return joins.align_columns(side("l_linenumber < 4"), side("l_linenumber >= 4"))


@query("jo23_dedupe_overlaps")
def jo23(spark, d):
    return joins.dedupe_overlaps(wide_pages(boxes(spark, d)).withColumn("digits", F.col("id") % 3).withColumn("conf", F.lit(1.0)))


@query("ag6_column_clusters")
def ag6(spark, d):
    return aggregates.cluster_columns(wide_pages(boxes(spark, d)).select("page", "id", F.col("y0").alias("x0"), F.col("y1").alias("x1")))


@query("ag8_lines")
def ag8(spark, d):
    return aggregates.lines_of(wide_pages(boxes(spark, d)))


@query("fi10_box_predicates", f"""SELECT l.page, l.id, r.id AS other, round({_IOU}, 6) AS iou, round(({_IX}) / 32.0, 6) AS share, (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1 AS inside, least(l.x1, r.x1) > greatest(l.x0, r.x0) AS xo
FROM {_A} l JOIN {_B} r ON l.page = r.page AND least(l.y1, r.y1) >= greatest(l.y0, r.y0)""")
def fi10(spark, d):
    a, b = _sides(spark, d)
    l, r = g.box("l"), g.box("r")  # noqa: E741
    j = joins.banded(a, b, ["page"], 8.0, F.least("l.y1", "r.y1") >= F.greatest("l.y0", "r.y0"))
    return j.select(F.col("l.page").alias("page"), F.col("l.id").alias("id"), F.col("r.id").alias("other"), F.round(g.iou(l, r), 6).alias("iou"), F.round(g.overlap_share(l, r), 6).alias("share"), g.center_in(l, r).alias("inside"), g.x_overlap(l, r).alias("xo"))


@query("pr11_norm_boxes", f"SELECT page, id, y0, list_transform([y0 * 1000 / 60, x0 * 1000 / 90, y1 * 1000 / 60, x1 * 1000 / 90], lambda v: round(v)::INT) AS norm FROM {BOXES}")
def pr11(spark, d):
    return boxes(spark, d).select("page", "id", "y0", g.to_norm(g.box(), F.lit(90.0), F.lit(60.0)).alias("norm"))


@query("fi18_colours", "SELECT p_partkey, abs((a >> 16) & 255 - (b >> 16) & 255) <= 24 AND abs(((a >> 8) & 255) - ((b >> 8) & 255)) <= 24 AND abs((a & 255) - (b & 255)) <= 24 AS alike FROM (SELECT p_partkey, (p_partkey * 7919 % 16777216)::INT AS a, (p_partkey * 7919 % 16777216 + 5140 * (p_size % 3))::INT AS b FROM part)".replace("abs((a >> 16) & 255 - (b >> 16) & 255)", "abs(((a >> 16) & 255) - ((b >> 16) & 255))"))
def fi18(spark, d):
    a = (F.col("p_partkey") * 7919 % 16777216).cast("int")
    b = (F.col("p_partkey") * 7919 % 16777216 + 5140 * (F.col("p_size") % 3)).cast("int")
    return table(spark, d, "part").select("p_partkey", g.similar_colour(a, b).alias("alike"))


@query("ag14_alignment", f"""SELECT page, CASE WHEN l <= r AND l <= c THEN 'left' WHEN r <= c THEN 'right' ELSE 'centre' END AS align FROM (
SELECT page, round(stddev_pop(y0), 6) AS l, round(stddev_pop(y0 + id), 6) AS r, round(stddev_pop((y0 + y0 + id) / 2), 6) AS c FROM {BOXES} GROUP BY page)""")
def ag14(spark, d):
    b = boxes(spark, d).withColumns({"x0": F.col("y0"), "x1": F.col("y0") + F.col("id")})
    return b.groupBy("page").agg(*aggregates.alignment())


@query("ag15_free_bounds", f"SELECT l.page, l.id, l.y0, max(r.x1) FILTER (WHERE r.x1 <= l.x0) AS left_bound, min(r.x0) FILTER (WHERE r.x0 >= l.x1) AS right_bound FROM (SELECT DISTINCT * FROM {_A}) l JOIN (SELECT DISTINCT * FROM {_B}) r ON l.page = r.page AND least(l.y1, r.y1) >= greatest(l.y0, r.y0) GROUP BY l.page, l.id, l.y0")
def ag15(spark, d):
    a, b = _sides(spark, d)
    return orders.free_bounds(a.distinct(), b.distinct(), ["page"], 8.0)