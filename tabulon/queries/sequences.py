"""Windows, sorts, limits and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import orders, reshape, windows
from ..registry import query
from .base import BOXES, boxes, items, table, wide_pages

_E = "(SELECT *, CASE WHEN event_type = 'purchase' THEN 'g' || event_id END AS g FROM events)"
_KEYS = ["user_id"]


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("g", F.when(F.col("event_type") == "purchase", F.concat(F.lit("g"), F.col("event_id").cast("string"))))


_ORD = ["ts", "event_id"]


@query("wi1_forward_fill", f"SELECT event_id, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM {_E}")
def wi1(spark, d):
    return _events(spark, d).select("event_id", windows.forward_fill(F.col("g"), _KEYS, _ORD).alias("grp"))


@query("wi3_back_fill", f"SELECT event_id, first_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS grp FROM {_E}")
def wi3(spark, d):
    return _events(spark, d).select("event_id", windows.back_fill(F.col("g"), _KEYS, _ORD).alias("grp"))


@query("wi2_title_rows", """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type FROM events),
c AS (SELECT *, n = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY n) AS new FROM r)
SELECT user_id, n::DOUBLE AS ord, 'item' AS kind, event_type AS text FROM c UNION ALL SELECT user_id, n - 0.5::DOUBLE, 'title', event_type FROM c WHERE new""")
def wi2(spark, d):
    e = _events(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return windows.title_rows(e, "event_type", ["user_id"], "n")


@query("wi4_restarts", "SELECT * FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber = 1 AND lag(l_linenumber) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1 AS restart FROM lineitem) WHERE restart")
def wi4(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return windows.with_restarts(table(spark, d, "lineitem").select(*order), "l_linenumber", order).where("restart").select("l_orderkey", "l_partkey", "l_linenumber", "restart")


@query("wi5_trust_streak", """SELECT event_id, sum(ok) OVER (PARTITION BY user_id, b ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM (
SELECT *, sum(1 - ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT *, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM events))""")
def wi5(spark, d):
    e = _events(spark, d).withColumn("ok", F.col("event_type") != "error")
    return windows.with_streak(e, "ok", _KEYS, _ORD).select("event_id", "streak")


@query("wi6_readiness", """SELECT event_id, count(*) OVER a >= 20 AND sum(ok) OVER a >= 0.95 * count(*) OVER a AND min(ok) OVER b = 1 AS ready FROM (SELECT *, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM events)
WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)""")
def wi6(spark, d):
    return _events(spark, d).select("event_id", windows.ready(F.col("event_type") != "error", _KEYS, _ORD).alias("ready"))


@query("wi7_smoothing", "SELECT event_id, floor(CASE WHEN count(value) OVER w >= 3 THEN 0.7 * value + 0.3 * avg(value) OVER w ELSE value END * 1000 + 0.01)::BIGINT AS z FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def wi7(spark, d):
    return _events(spark, d).select("event_id", F.floor(windows.smooth(F.col("value"), ["user_id", "event_type"], own=0.7) * 1000 + 0.01).alias("z"))


@query("wi8_length_outlier", "SELECT p_partkey, count(*) OVER w >= 3 AND abs(length(p_name) - median(length(p_name)) OVER w) >= 2 AS outlier FROM part WINDOW w AS (PARTITION BY p_brand)")
def wi8(spark, d):
    return table(spark, d, "part").select("p_partkey", windows.length_outlier(F.length("p_name"), ["p_brand"]).alias("outlier"))


_SEG = """WITH r AS (SELECT p_partkey AS ord, p_brand AS doc, p_size = 1 AS title, p_size * 1000 + p_partkey % 997 AS num FROM part),
s AS (SELECT *, sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN NOT title THEN num END AS n FROM r),
t AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY doc, seg ORDER BY ord) > n, false) AS down FROM s),
g AS (SELECT doc, seg, count(n) >= 3 AND count(DISTINCT n) >= 0.95 * count(n) AND max(n) < 100000 AND bool_or(down) AS ok FROM t GROUP BY ALL)
SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY seg, CASE WHEN title THEN -1 WHEN ok THEN n ELSE 0 END, ord)::INT AS place FROM t JOIN g USING (doc, seg)"""


@query("wi9_order_in_segments", _SEG)
def wi9(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("doc"), (F.col("p_size") == 1).alias("title"), (F.col("p_size") * 1000 + F.col("p_partkey") % 997).alias("num"))
    return windows.order_by_number(p, ["doc"], "title", "num", "ord").select("doc", "ord", "place")


@query("wi10_islands", f"""SELECT page, id, y0, sum(new) OVER (PARTITION BY page ORDER BY y0, id, x0 ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, id, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS new FROM {BOXES})""")
def wi10(spark, d):
    return windows.with_islands(boxes(spark, d), "y0", "y1", ["page"], ["y0", "id", "x0"], 3.0).select("page", "id", "y0", "island")


@query("ag7_edge_clusters", f"""SELECT page, island, round(avg(y0), 4) AS edge, count(*) AS n FROM (SELECT page, y0, sum(new) OVER (PARTITION BY page ORDER BY y0 RANGE UNBOUNDED PRECEDING)::BIGINT AS island FROM (
SELECT page, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0) <= 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT page, y0 FROM {BOXES}))) GROUP BY page, island""")
def ag7(spark, d):
    e = windows.with_islands(boxes(spark, d).select("page", "y0").distinct(), "y0", "y0", ["page"], ["y0"], 2.0)
    return e.groupBy("page", "island").agg(F.round(F.avg("y0"), 4).alias("edge"), F.count("*").alias("n"))


@query("wi11_recent_repeats", """SELECT event_id, coalesce(event_type = lag(event_type, 1) OVER w, false) OR coalesce(event_type = lag(event_type, 2) OVER w, false) OR coalesce(event_type = lag(event_type, 3) OVER w, false) OR coalesce(event_type = lag(event_type, 4) OVER w, false) AS again
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def wi11(spark, d):
    return _events(spark, d).select("event_id", windows.repeats_recent([F.col("event_type")], _KEYS, _ORD).alias("again"))


@query("wi13_page_bridge", "SELECT user_id, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AS goes_on FROM events")
def wi13(spark, d):
    return _events(spark, d).select("user_id", "event_id", orders.goes_on("event_type", ["user_id"], ["ts", "event_id"]).alias("goes_on"))


@query("wi14_pacing", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM events")
def wi14(spark, d):
    return _events(spark, d).select("event_id", windows.recent_count(F.col("ts"), ["event_type"]).alias("n"))


@query("wi15_ranking", """SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::INT AS q, round(percent_rank() OVER w, 6) AS pr
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)""")
def wi15(spark, d):
    found = orders.ranks(["p_brand"], "p_retailprice", "p_partkey")
    return table(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(n) if n == "pr" else c.alias(n) for n, c in found.items()))


@query("wi16_column_runs", f"""SELECT page, id, x0, y0, sum(new) OVER (PARTITION BY page ORDER BY x0, y0, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (
SELECT *, CASE WHEN abs(x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, y0, id)) <= 3 THEN 0 ELSE 1 END AS new FROM {BOXES})""")
def wi16(spark, d):
    order = [F.col(c).asc_nulls_last() for c in ("x0", "y0", "id")]
    b = boxes(spark, d).withColumn("_n", windows.same_run(F.col("x0"), ["page"], order, 3.0))
    return b.select("page", "id", "x0", "y0", F.sum("_n").over(Window.partitionBy("page").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


@query("wi17_titles_with_prices", """WITH e AS (SELECT event_id, user_id, ts, event_type = 'signup' AS title, event_type = 'purchase' AS price FROM events),
t AS (SELECT *, sum(title::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM e)
SELECT min(event_id) FILTER (WHERE title) AS event_id, count(*) FILTER (WHERE price) AS prices FROM t WHERE seg > 0 GROUP BY user_id, seg HAVING count(*) FILTER (WHERE price) > 0""")
def wi17(spark, d):
    e = _events(spark, d).withColumns({"title": F.col("event_type") == "signup", "price": F.col("event_type") == "purchase"})
    return orders.titles_with_prices(e, ["user_id"], ["ts", "event_id"], "title", "price", "event_id")


@query("so1_reading_order", f"SELECT page, id, y0, x1, row_number() OVER (PARTITION BY page ORDER BY y0, x1 DESC, id)::INT AS place FROM {BOXES}")
def so1(spark, d):
    return boxes(spark, d).select("page", "id", "y0", "x1", orders.reading_order(["page"]).alias("place"))


@query("so2_layout_order", f"SELECT page, id, y0, row_number() OVER (PARTITION BY page ORDER BY floor(x0 / 40) DESC, round(y0 / 5), x1 DESC, id, y0)::INT AS place FROM {BOXES}")
def so2(spark, d):
    return boxes(spark, d).select("page", "id", "y0", orders.layout_order(["page"], 40, 5, ["id", "y0"]).alias("place"))


@query("so3_newest_of_each", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def so3(spark, d):
    return windows.newest(_events(spark, d), _KEYS, [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", "event_type")


@query("so5_report_top", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 8")
def so5(spark, d):
    return orders.top_for_report(table(spark, d, "part"), "p_brand", 8)


@query("so6_replay_sample")
def so6(spark, d):
    from ..operators.learn import replay

    return replay(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 500, 7)


@query("se1_merged_tables", """SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS merged FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)""")
def se1(spark, d):
    e = _events(spark, d).withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return reshape.merge_continued(e, F.col("event_type"), "o", ["user_id"]).select("event_id", "merged")


@query("se2_unpivot_blocks", """SELECT l_orderkey, l_linenumber, l_partkey, 0 AS block, 'quantity' AS name, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, 'price', l_extendedprice FROM lineitem""")
def se2(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("quantity").alias("a"), "l_quantity", F.lit("price").alias("b"), "l_extendedprice")  # noqa: E741
    return reshape.unpivot_blocks(l, ["l_orderkey", "l_linenumber", "l_partkey"], [["a", "l_quantity"], ["b", "l_extendedprice"]], ["name", "v"])


@query("se3_drop_empty_columns", """WITH c AS (SELECT l_orderkey AS tbl, l_partkey AS row, l_linenumber AS col, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS text FROM lineitem),
u AS (SELECT tbl, col, row_number() OVER (PARTITION BY tbl ORDER BY col) - 1 AS k FROM c GROUP BY tbl, col HAVING bool_or(text <> ''))
SELECT tbl, row, k::INT AS col, text FROM c JOIN u USING (tbl, col)""")
def se3(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("text"))
    return reshape.drop_empty_columns(c, ["tbl"])


@query("se4_jaccard", """SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS j
FROM (SELECT p_partkey, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part) a JOIN (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def se4(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.array_distinct(F.split("p_name", " ")).alias("x"))
    q = p.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return p.join(q, "a").select("a", "b", F.round(reshape.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query("se5_backup_merge", "SELECT * FROM (SELECT DISTINCT user_id, event_id // 20 AS lot FROM events WHERE event_id % 2 = 0) a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.event_id // 20 = a.lot)")
def se5(spark, d):
    from ..operators.joins import unseen

    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 20).alias("lot"))
    return unseen(e.where("event_id % 2 = 0").select("user_id", "lot"), [e.where("event_id % 2 = 1")], ["user_id", "lot"])


@query("se6_row_kinds", """SELECT l_orderkey, CASE WHEN sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) > 0 THEN 'item' WHEN bool_or(l_returnflag = 'R') THEN 'header' WHEN count(*) = 1 THEN 'group' ELSE 'item' END AS kind FROM lineitem GROUP BY l_orderkey""")
def se6(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.08).alias("p"), F.bool_or(F.col("l_returnflag") == "R").alias("h"))
    return g.select("l_orderkey", reshape.row_kind(F.col("n"), F.col("p"), F.col("h"), F.col("n") == 1).alias("kind"))


@query("se7_set_operators", "(SELECT user_id, event_id // 100 AS lot FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id, event_id // 100 FROM events WHERE event_type = 'error') EXCEPT SELECT user_id, event_id // 100 FROM events WHERE event_type = 'signup'")
def se7(spark, d):
    e = table(spark, d, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id", F.floor(F.col("event_id") / 100).alias("lot"))
    return of("purchase").intersect(of("error")).subtract(of("signup"))


@query("se8_source_cascade", """SELECT user_id, event_id, 'purchase' AS source FROM events WHERE event_type = 'purchase'
UNION ALL SELECT user_id, event_id, 'view' FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL SELECT user_id, event_id, 'click' FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'view'))""")
def se8(spark, d):
    from ..operators.joins import cascade

    e = table(spark, d, "events")
    part = lambda t: e.where(F.col("event_type") == t).select("user_id", "event_id", F.lit(t).alias("source"))
    return cascade([part("purchase"), part("view"), part("click")], ["user_id"])


@query("se10_best_attempt", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def se10(spark, d):
    from ..operators.joins import best_by

    return best_by(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_extendedprice"), [F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("pr12_page_notes", "SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) AS notes FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def pr12(spark, d):
    return orders.notes(table(spark, d, "events"), ["user_id"], "event_type")


@query("sk12_merge_boxes")
def sk12(spark, d):
    from ..operators.aggregates import merge_boxes

    return merge_boxes(wide_pages(boxes(spark, d)).select("page", "x0", "y0", "x1", "y1"))


@query("ag24_first_occurrence", "SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def ag24(spark, d):
    return windows.first_by(table(spark, d, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", "p_partkey")


@query("ag1_group_counts", "SELECT grp, count(*) AS n, min(id) AS first_ord FROM (SELECT p_partkey AS id, p_brand AS grp FROM part) GROUP BY grp")
def ag1(spark, d):
    from ..operators.aggregates import in_first_order

    return in_first_order(items(spark, d), "grp", "id")
