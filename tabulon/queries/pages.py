"""Pages and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, groups, layout, learn, orders, reshape, windows
from ..registry import query
from ..sources import files
from ..streaming import events as s
from .base import BOXES, boxes, table, wide_pages

_W = f"(SELECT DISTINCT page, id, x0, y0, x1, y1, flag || status AS text FROM {BOXES})"


def _words(spark, d):
    return boxes(spark, d).withColumn("text", F.concat("flag", "status")).select("page", "id", "x0", "y0", "x1", "y1", "text").distinct()


@query("pr4_row_labels", f"SELECT page, y0, array_to_string(list_transform(list_sort(list({{'k': -x1, 't': text}}))[1:10], lambda s: s.t), ' ') AS label FROM {_W} GROUP BY page, y0")
def pr4(spark, d):
    return layout.row_labels(_words(spark, d), ["page", "y0"])


@query("pr6_page_titles", f"SELECT page, substr(array_to_string(list_transform(list_sort(list({{'k': -x1, 't': text}})), lambda s: s.t), ' '), 1, 60) AS title FROM (SELECT *, min(y0) OVER (PARTITION BY page) AS t FROM {_W}) WHERE y0 <= t + 2 GROUP BY page")
def pr6(spark, d):
    return layout.page_title(_words(spark, d), ["page"], 2.0)


@query("pr7_labels_from_cells", "SELECT l_orderkey, arg_min(l_suppkey::VARCHAR, l_linenumber * 1000000 + l_suppkey) FILTER (WHERE l_suppkey < 10000) AS no, CASE WHEN count(*) > 0 THEN 'x' || l_orderkey END AS name FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def pr7(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    n = l.select("l_orderkey", F.col("l_linenumber").alias("col"), F.col("l_suppkey").cast("string").alias("text"))
    # several cells at one place: the least number there
    n = n.groupBy("l_orderkey", "col").agg(F.min(F.col("text").cast("int")).cast("string").alias("text"))
    names = l.select("l_orderkey").distinct().select("l_orderkey", F.lit(99).alias("col"), F.concat(F.lit("x"), F.col("l_orderkey").cast("string")).alias("text"))
    return layout.labels_from_cells(n.unionByName(names), ["l_orderkey"])


@query("jo20_headers", f"""WITH w AS (SELECT * FROM {_W}), c AS (SELECT page, id AS col, min(x0) AS x0, max(x1) AS x1, max(y0) AS top FROM w GROUP BY page, id),
h AS (SELECT w.page, c.col, w.text, w.x1, w.y1, max(w.y1) OVER (PARTITION BY w.page, c.col) AS m FROM w JOIN c ON w.page = c.page AND least(w.x1, c.x1) - greatest(w.x0, c.x0) >= 0.3 * least(w.x1 - w.x0, c.x1 - c.x0) AND w.y1 <= c.top AND w.y1 >= c.top - 18)
SELECT page, col, array_to_string(list_transform(list_sort(list({{'k': -x1, 't': text}}))[1:8], lambda s: s.t), ' ') AS header FROM h WHERE y1 >= m - 5.2 GROUP BY page, col""")
def jo20(spark, d):
    w = _words(spark, d)
    c = w.groupBy("page", F.col("id").alias("col")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y0").alias("y0"))
    return layout.headers(w, c, ["page"], 2.0)


@query("fi3_glued", f"SELECT page, id, y0, coalesce(lag(text) OVER w = 'RF' AND x0 - lag(x1) OVER w < 2.4, false) OR coalesce(lead(text) OVER w = 'RF' AND lead(x0) OVER w - x1 < 2.4, false) AS glued FROM {_W} WINDOW w AS (PARTITION BY page ORDER BY x0, y0, text)")
def fi3(spark, d):
    w = _words(spark, d).withColumn("size", F.lit(20.0)).withColumn("_o", F.struct("x0", "y0", "text"))
    return w.select("page", "id", "y0", layout.glued(["page"], "_o", 0.12, F.col("text") == "RF").alias("glued"))


@query("fi11_complete_numbers", f"""SELECT l.page, l.id, l.y0 FROM (SELECT DISTINCT page, id, x0, y0, x1, y1 FROM {BOXES} WHERE flag = 'A') l WHERE NOT EXISTS (SELECT 1 FROM {BOXES} r WHERE r.flag <> 'A' AND r.page = l.page AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 2 AND greatest(r.x0 - l.x1, l.x0 - r.x1) BETWEEN 0 AND 1.79999)""")
def fi11(spark, d):
    b = boxes(spark, d).select("page", "id", "x0", "y0", "x1", "y1", "flag")
    return layout.fragments(b.where("flag = 'A'").drop("flag").distinct(), b.where("flag <> 'A'"), ["page"], 8.0).select("page", "id", "y0")


@query("fi13_page_gates", "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 0) = count(*) AND count(DISTINCT l_linenumber) >= 2 AND count(*) FILTER (WHERE l_discount > 0.09) = 0 AS good FROM lineitem GROUP BY l_orderkey")
def fi13(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 0).alias("p"), F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("h"), F.count_if(F.col("l_discount") > 0.09).alias("t"))
    return g.select("l_orderkey", layout.good_page(F.col("p"), F.col("n"), F.col("h"), F.col("t")).alias("good"))


@query("fi14_access", "SELECT event_id FROM events WHERE user_id IN (1, 2, 3, 5, 8) AND epoch(TIMESTAMP '2030-01-01 00:00:00') - floor(epoch(ts)) > 60")
def fi14(spark, d):
    from ..functions.dates import expired

    e = table(spark, d, "events")
    return e.where(F.col("user_id").isin(1, 2, 3, 5, 8) & expired(F.col("ts"), F.lit("2030-01-01 00:00:00").cast("timestamp"), 1)).select("event_id")


@query("fi16_number_like", "SELECT p_partkey, p_size % 2 = 0 AND p_size >= 0.6 * 20 AND p_size <= 1.7 * 20 AND p_partkey % 40 >= 0.8 * 20 AS ok FROM part")
def fi16(spark, d):
    return table(spark, d, "part").select("p_partkey", layout.number_like(F.col("p_partkey") % 40, F.col("p_size"), F.lit(20), F.col("p_size") % 2 == 0).alias("ok"))


@query("fi17_line_features", """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN row_number() OVER w = 1 THEN 'top' END, CASE WHEN lead(turn) OVER w IS NULL THEN 'foot' END,
CASE WHEN len(string_split_regex(trim(text), '\\s+')) <= 3 THEN 'len:short' END, CASE WHEN len(string_split_regex(trim(text), '\\s+')) > 10 THEN 'len:long' END], lambda x: x IS NOT NULL), ',') AS f FROM conversations WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def fi17(spark, d):
    c = table(spark, d, "conversations").where("text <> ''").withColumns({"x0": F.lit(0.0), "x1": F.lit(10.0), "width": F.lit(100.0)})
    f = {k: v for k, v in layout.line_features(["conv_id"], "turn").items() if k in ("top", "foot", "len:short", "len:long")}
    return c.select("conv_id", "turn", F.array_join(layout.feature_array(f), ",").alias("f"))


@query("ag10_column_features", "SELECT l_orderkey, l_linenumber, count(*) AS n, round(count(*) FILTER (WHERE l_partkey >= 1000) / count(*), 6) AS grouped, count(DISTINCT length(l_partkey::VARCHAR)) = 1 AS same_length FROM lineitem GROUP BY ALL")
def ag10(spark, d):
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("digits"), F.when(F.col("l_partkey") >= 1000, ",").otherwise("").alias("sep"))
    return layout.column_features(n, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n", F.round("grouped", 6).alias("grouped"), "same_length")


@query("ag10_column_ranks", f"SELECT page, id, y0, row_number() OVER (PARTITION BY page ORDER BY y0, y1, id)::INT AS from_left, row_number() OVER (PARTITION BY page ORDER BY y1 DESC, y0 DESC)::INT AS from_right FROM (SELECT page, y0, y1, min(id) AS id FROM {BOXES} GROUP BY ALL)")
def ag10b(spark, d):
    b = boxes(spark, d).groupBy("page", "y0", "y1").agg(F.min("id").alias("id"))
    left, right = layout.column_ranks(["page"], "y0", "y1")
    return b.select("page", "id", "y0", left.alias("from_left"), right.alias("from_right"))


@query("ag13_group_columns", """WITH c AS (SELECT l_orderkey AS tbl, l_linenumber AS col, count(*) AS cells, sum(l_quantity) AS covered, count(*) FILTER (WHERE l_returnflag = 'R') AS p FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey AS tbl, max(l_quantity) AS most FROM lineitem GROUP BY ALL)
SELECT tbl, col, covered FROM c JOIN m USING (tbl) WHERE p = 0 AND covered >= 1.8 * cells AND covered >= 0.5 * most""")
def ag13(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("col"), F.lit(0.0).alias("r0"), F.col("l_quantity").alias("r1"), (F.col("l_returnflag") == "R").alias("has_price"))
    return layout.group_columns(c, ["tbl"])


@query("ag23_mean_shapes", "SELECT label, round(list_sum(list_transform(m, lambda x: abs(x))), 3) AS total FROM (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, median(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i) GROUP BY label)")
def ag23(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return layout.mean_shape(e, ["label"], "vec").select("label", F.round(F.aggregate("shape", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"))


_LINES = "SELECT user_id AS doc, event_id AS id, event_type = 'purchase' AS is_price, event_type = 'signup' AS t, event_type || event_id AS text FROM events"


@query("ml5_group_finder", f"""WITH l AS ({_LINES}), s AS (SELECT *, sum(t::INT) OVER (PARTITION BY doc ORDER BY id ROWS UNBOUNDED PRECEDING) AS seg FROM l), u AS (SELECT *, bool_or(is_price) OVER (PARTITION BY doc, seg) AS used FROM s)
SELECT doc, id, grp FROM (SELECT doc, id, is_price, coalesce(last_value(CASE WHEN t AND used THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY id ROWS UNBOUNDED PRECEDING), '') AS grp FROM u) WHERE is_price""")
def ml5(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 1000).alias("page"), F.col("event_id").alias("id"), F.col("event_id").cast("double").alias("y0"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"), (F.col("event_type") == "purchase").alias("is_price"), F.when(F.col("event_type") == "signup", 0.9).otherwise(0.1).alias("p"))
    where = {"x0": F.lit(0.0), "x1": F.lit(100.0), "y": F.col("y0"), "h": F.lit(0.0), "end": F.lit(None).cast("double"), "kind": F.lit("bar"), "name": F.col("text"), "key": F.col("text"), "tid": F.col("id")}
    titles = e.where("not is_price").withColumns(where)
    prices = e.where("is_price").select("doc", "page", "id", F.lit(50.0).alias("x"), F.col("y0").alias("y"))
    return groups.find_groups(prices, titles).select("doc", "id", "grp")


@query("jo26_settled_groups", """SELECT e.event_id, CASE WHEN a.name = 'n' || (e.event_id % 2) THEN a.name ELSE 'mine' END AS settled FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, event_id AS at, 'n' || (event_id % 2) AS name FROM events WHERE event_type = 'view') a ON e.user_id = a.user_id AND e.event_id >= a.at""")
def jo26(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("page"), "event_type", F.concat(F.lit("n"), (F.col("event_id") % 2).cast("string")).alias("name"))
    it = e.where("event_type = 'click'").select("user_id", "page", F.col("name").alias("taught"), F.lit("mine").alias("mine"))
    out = layout.settle_group(it, e.where("event_type = 'view'").select("user_id", "page", "name"), "user_id", text.same_group)
    return out.select(F.col("page").alias("event_id"), "settled")


@query("jo27_words_outside_titles", f"SELECT l.page, l.id, l.y0 FROM (SELECT DISTINCT page, id, x0, y0, x1, y1 FROM {BOXES} WHERE flag = 'A') l WHERE NOT EXISTS (SELECT 1 FROM {BOXES} r WHERE r.flag = 'R' AND r.page = l.page AND (l.x0 + l.x1) / 2 BETWEEN r.x0 - 10 AND r.x1 + 10 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 3 AND r.y1 + 3)")
def jo27(spark, d):
    b = boxes(spark, d)
    titles = b.where("flag = 'R'").select("page", (F.col("x0") - 10).alias("x0"), (F.col("y0") - 3).alias("y0"), (F.col("x1") + 10).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return layout.not_in_titles(b.where("flag = 'A'").select("page", "id", "x0", "y0", "x1", "y1").distinct(), titles, ["page"], 8.0).select("page", "id", "y0")


@query("jo16_same_cells", """WITH a AS (SELECT l_orderkey, l_quantity AS x FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey, l_quantity AS x FROM lineitem WHERE l_returnflag = 'R')
SELECT x.l_orderkey, len(x.v) = len(y.v) AND coalesce(list_bool_and(list_transform(list_zip(x.v, y.v), lambda p: coalesce(abs(p[1] - p[2]) <= 2, false))), false) AS same FROM (SELECT l_orderkey, list(x ORDER BY x) AS v FROM a GROUP BY 1) x JOIN (SELECT l_orderkey, list(x ORDER BY x) AS v FROM b GROUP BY 1) y USING (l_orderkey)""")
def jo16(spark, d):
    side = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_orderkey", F.col("l_quantity").alias("x"))
    return orders.same_cells(side("A"), side("R"), "l_orderkey", "x", 2)


@query("wi12_joined_pieces")
def wi12(spark, d):
    l = wide_pages(boxes(spark, d))  # noqa: E741
    t = F.when(F.col("id") % 2 == 0, F.lit("416,410")).otherwise(F.lit("21"))
    return reshape.join_pieces(l.select(F.col("page").alias("line"), "id", t.alias("text"), "x0", "x1", F.lit(3.0).alias("gap")))


@query("wi18_page_rows")
def wi18(spark, d):
    return aggregates.lines_of(wide_pages(boxes(spark, d)))


@query("sk11_pages")
def sk11(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("h"), (F.col("p_size") == 1).alias("header"))
    return reshape.paginate(p, "h", 400.0, ["p_brand"], "p_partkey", "header")


@query("ml11_feedback", "SELECT user_id AS template, CASE WHEN bool_and(event_type <> 'error') THEN count(*) ELSE count(*) FILTER (WHERE event_id > (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error')) END AS streak FROM events e GROUP BY user_id".replace("(SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error')", "b").replace("FROM events e", "FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM events) e"))
def ml11(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("template"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    empty = spark.createDataFrame([], "template bigint, streak bigint, checks bigint, agree bigint, updated bigint")
    return learn.learn_template(e, empty).select("template", "streak")


@query("ml19_kept_samples", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2000")
def ml19(spark, d):
    from ..storage import shared_path

    path = shared_path(spark, "samples")
    files.append_or_compact(table(spark, d, "events").select(F.col("event_id").alias("seq")), path, 2000)
    kept = spark.read.parquet(path)
    return kept.select(F.col("seq").alias("event_id")).orderBy(F.col("event_id").desc()).limit(2000)


@query("sm5_idle_windows", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 90 SECOND THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT event_type, min(ts) AS "start", count(*) AS n FROM g GROUP BY event_type, k""")
def sm5(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return s.sessions(e, "event_type", "ts", "90 seconds").select("event_type", "start", "n")


@query("ql9_distinct_warnings", "SELECT user_id, floor((row_number() OVER (ORDER BY user_id) - 1) / 10)::BIGINT AS chunk FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')")
def ql9(spark, d):
    u = table(spark, d, "events").where("event_type = 'error'").select("user_id").distinct()
    return windows.numbered(u, ["user_id"]).select("user_id", F.floor(F.col("place") / 10).alias("chunk"))
