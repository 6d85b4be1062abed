"""Votes, statistics, accuracy, models, quotas and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import quota_day
from ..operators import aggregates, learn, orders
from ..registry import query
from ..streaming import events as s
from .base import stream, table


@query("ag2_currency", "SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def ag2(spark, d):
    return aggregates.most_frequent(table(spark, d, "events"), ["user_id"], "event_type")


@query("ag4_majority", """WITH v AS (SELECT l_orderkey AS target, l_linenumber AS o, l_partkey % 20 AS t FROM lineitem)
SELECT target, arg_min(t, (o, t::VARCHAR))::VARCHAR AS text FROM (SELECT *, count(*) OVER (PARTITION BY target, t) AS n FROM v) WHERE n >= 2 GROUP BY target""")
def ag4(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("vote_ord"), (F.col("l_partkey") % 20).cast("string").alias("text"))
    return aggregates.majority(v)


@query("ag5_readers", """WITH r AS (SELECT l_suppkey AS page, l_orderkey AS target, CASE WHEN l_partkey % 9 = 0 THEN '77' ELSE (100000 + l_partkey % 3)::VARCHAR END AS dg FROM lineitem),
n AS (SELECT page, target, dg, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY page, target) AS al FROM n QUALIFY row_number() OVER (PARTITION BY page, target ORDER BY n DESC, dg) = 1), t AS (SELECT page, list_sort(list(length(dg)))[count(*) // 2 + 1] AS typical FROM b GROUP BY page)
SELECT page, target, dg AS digits, n AS agree, (al - n)::BIGINT AS against, typical::INT AS typical, n >= 2 AND n >= 2 * (al - n) AND length(dg) > typical - 3 AS sure FROM b JOIN t USING (page)""")
def ag5(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("target"), F.when(F.col("l_partkey") % 9 == 0, "77").otherwise((100000 + F.col("l_partkey") % 3).cast("string")).alias("text"))
    return aggregates.readers_agree(r, ["page"])


@query("ag9_column_stats", """SELECT l_orderkey AS tbl, l_linenumber AS col, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS prices, round(avg(length(l_partkey::VARCHAR)), 6) AS mean_len, count(*) FILTER (WHERE l_partkey < 10000) AS ints FROM lineitem GROUP BY ALL""")
def ag9(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("col"), F.col("l_suppkey").alias("row"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_returnflag") == "R").alias("has_price"), F.lit(False).alias("has_image"), F.lit("").alias("header"))
    return aggregates.column_stats(c, ["tbl", "col"]).select("tbl", "col", "n", "prices", F.round("mean_len", 6).alias("mean_len"), "ints")


@query("ag9_column_roles", """WITH c AS (SELECT l_suppkey AS tbl, l_linenumber AS col, l_partkey::VARCHAR AS t, l_returnflag = 'R' AS p, CASE WHEN l_partkey < 10000 THEN l_partkey END AS i,
lag(CASE WHEN l_partkey < 10000 THEN l_partkey END) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) AS before FROM lineitem),
s AS (SELECT tbl, col, count(*)::DOUBLE AS n, count(*) FILTER (WHERE p) AS prices, count(i)::DOUBLE AS ints, count(*) FILTER (WHERE i > before) AS ups, count(*) FILTER (WHERE length(t) >= 4) AS codes FROM c GROUP BY ALL)
SELECT tbl, col, CASE WHEN prices >= 0.4::DOUBLE * n THEN 'price' WHEN ints >= 0.8::DOUBLE * n AND ints >= 3 AND ups >= 0.7::DOUBLE * (ints - 1) THEN 'row' WHEN ints >= 0.8::DOUBLE * n THEN 'qty' WHEN codes >= 0.7::DOUBLE * n THEN 'code' ELSE 'text' END AS role FROM s""")
def ag9b(spark, d):
    row = F.struct("l_orderkey", "l_partkey")  # a supplier can have a line number of an order twice
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tbl"), F.col("l_linenumber").alias("col"), row.alias("row"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_returnflag") == "R").alias("has_price"), F.lit(False).alias("has_image"), F.lit("").alias("header"))
    return aggregates.column_stats(c, ["tbl", "col"]).select("tbl", "col", aggregates.column_role(lambda k: F.lit(False)).alias("role"))


@query("fi8_sequences", "SELECT l_orderkey, n, good, n >= 3 AND good >= 0.7 * (n - 1) AS is_seq FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE d = 1) AS good FROM (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM lineitem) GROUP BY l_orderkey)")
def fi8(spark, d):
    return aggregates.is_sequence(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query("fi9_increasing", "SELECT l_orderkey, n, good, n >= 3 AND good >= 0.7 * (n - 1) AS is_seq FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE d > 0) AS good FROM (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS d FROM lineitem) GROUP BY l_orderkey)")
def fi9(spark, d):
    return aggregates.is_sequence(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice", step_one=False)


@query("ag11_common_columns", "SELECT l_suppkey, l_linenumber, count(DISTINCT l_orderkey) AS rows FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 0.15 * (SELECT count(DISTINCT x.l_orderkey) FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey)".replace("(SELECT count(DISTINCT x.l_orderkey) FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey)", "max((SELECT c FROM (SELECT l_suppkey AS k, count(DISTINCT l_orderkey) AS c FROM lineitem GROUP BY 1) z WHERE z.k = lineitem.l_suppkey))"))
def ag11(spark, d):
    return aggregates.common_columns(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "l_orderkey", 0.15)


@query("ag12_repeated_lines", "SELECT user_id, event_type, count(DISTINCT event_id % 12) AS pages FROM events GROUP BY ALL HAVING count(DISTINCT event_id % 12) >= greatest(3, ceil(0.6 * max((SELECT c FROM (SELECT user_id AS u, count(DISTINCT event_id % 12) AS c FROM events GROUP BY 1) z WHERE z.u = events.user_id))))")
def ag12(spark, d):
    e = table(spark, d, "events").withColumn("page", F.col("event_id") % 12)
    return aggregates.repeated_on_pages(e, "user_id", "page", "event_type")


@query("ag16_outline_names", "SELECT k, arg_min(name, (-n, name)) AS name, max(n) AS n FROM (SELECT p_partkey % 40 AS k, substr(p_brand, 7, 1) AS name, count(*) AS n FROM part GROUP BY ALL) GROUP BY k HAVING max(n) >= 2 AND max(n) >= 0.2 * sum(n)")
def ag16(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("k"), F.substring("p_brand", 7, 1).alias("name"))
    return aggregates.outline_names(p, "k", "name", purity=0.2)


@query("ag17_infer_letters")
def ag17(spark, d):
    n = table(spark, d, "nation").select(F.lower("n_name").alias("word"))
    words = n.select(F.col("word").alias("word_id"), F.posexplode(F.split("word", "")).alias("pos", "code")).where("code <> ''")
    known = words.select("code", F.col("code").alias("letter")).distinct().where("code not in ('a', 'r')")
    return aggregates.infer_letters(words, known, n)


@query("ag19_counters", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def ag19(spark, d):
    return s.counters(table(spark, d, "events"), "event_type", F.to_date("ts"))


@query("ag20_usage_by_day", "SELECT event_type AS model, CAST(CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, count(*) AS requests, sum(user_id)::BIGINT AS tokens_in, sum(event_id)::BIGINT AS tokens_out, bool_or(value > 99) AS exhausted FROM events GROUP BY ALL")
def ag20(spark, d):
    u = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"), (F.col("value") > 99).alias("exhausted"))
    return aggregates.usage_by_day(u, quota_day(F.col("ts")))


@query("ag21_remaining", "SELECT event_type, greatest(0, 2500 - count(*)) AS rest, CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 2 ELSE 0 END AS needed FROM events GROUP BY event_type")
def ag21(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("u"))
    kind = F.when(F.col("event_type") == "view", "pdf").when(F.col("event_type") == "click", "image").otherwise("other")
    return n.select("event_type", aggregates.remaining(F.lit(2500), F.col("u"), F.lit(False)).alias("rest"), aggregates.requests_needed(kind, F.lit(7)).alias("needed"))


_R = "SELECT r_name AS family, n_name AS item, c_acctbal > 0 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _truth(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("r_name").alias("family"), F.col("n_name").alias("item"), (F.col("c_acctbal") > 0).alias("ok"))


@query("ag22_accuracy", f"SELECT family, item, count(*) AS total, count(*) FILTER (WHERE ok) AS right FROM ({_R}) GROUP BY ROLLUP (family, item)")
def ag22(spark, d):
    return aggregates.accuracy(_truth(spark, d), "family", "item", F.col("ok"))


@query("ag26_cube", f"SELECT family, ok, count(*) AS n, grouping(family)::INT AS gf FROM ({_R}) GROUP BY CUBE (family, ok)")
def ag26(spark, d):
    return _truth(spark, d).cube("family", "ok").agg(F.count("*").alias("n"), F.grouping("family").cast("int").alias("gf"))


@query("ag22_leave_one_out", """WITH b AS (SELECT p_brand AS fold, p_size AS x, sum(CAST(p_retailprice * 100 AS BIGINT)) AS s, count(*) AS n FROM part GROUP BY ALL)
SELECT fold, x, round((sum(s) OVER (PARTITION BY x) - s) / nullif(sum(n) OVER (PARTITION BY x) - n, 0)::DOUBLE, 4) AS others_mean FROM b""")
def ag22b(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("fold"), F.col("p_size").alias("x"), (F.col("p_retailprice").cast("decimal(18,2)") * 100).cast("long").alias("y"))
    return aggregates.leave_one_out(p, "fold", "x", "y").select("fold", "x", F.round("others_mean", 4).alias("others_mean"))


@query("ag25_argmax", "SELECT l_orderkey, max(l_extendedprice) AS top, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey")
def ag25(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("part"))


@query("ag27_next_reader", """WITH r AS (SELECT r_regionkey AS o, r_name AS reader FROM region), p AS (SELECT DISTINCT user_id AS target FROM events WHERE event_type = 'error'), v AS (SELECT user_id AS target, r_name AS reader, count(*) AS n FROM events JOIN region ON r_regionkey = event_id % 4 GROUP BY ALL)
SELECT p.target, arg_min(r.reader, (coalesce(v.n, 0), r.o)) AS reader, min(coalesce(v.n, 0)) AS votes FROM p, r LEFT JOIN v ON v.reader = r.reader AND v.target = p.target GROUP BY p.target""")
def ag27(spark, d):
    e, r = table(spark, d, "events"), table(spark, d, "region")
    votes = e.join(r, r.r_regionkey == e.event_id % 4).select(F.col("user_id").alias("target"), F.col("r_name").alias("reader"))
    readers = r.select(F.col("r_name").alias("reader"), F.col("r_regionkey").alias("reader_ord"))
    return aggregates.next_reader(readers, votes, e.where("event_type = 'error'").select(F.col("user_id").alias("target")).distinct())


@query("ag28_reader_scores", "SELECT r_name AS reader, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = user_id % 3) AS ok FROM events JOIN region ON r_regionkey = event_id % 5 GROUP BY r_name")
def ag28(spark, d):
    e, r = table(spark, d, "events"), table(spark, d, "region")
    reads = e.join(r, r.r_regionkey == e.event_id % 5).select(F.col("user_id").alias("target"), F.col("r_name").alias("reader"), (F.col("event_id") % 3).cast("string").alias("text"))
    return aggregates.score_reads(reads, e.select(F.col("user_id").alias("target"), (F.col("user_id") % 3).cast("string").alias("text")).distinct())


@query("ag29_pair_distances", "SELECT p_brand, p_type, CASE WHEN count(*) >= 2 THEN round(avg(p_size), 6) ELSE 7.5 END AS dist FROM part GROUP BY ALL")
def ag29(spark, d):
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean_d"))
    g = g.withColumns({"u": F.lit(3.0), "v": F.lit(4.0), "sp": F.lit(0.5), "space": F.lit(True)})
    return g.select("p_brand", "p_type", aggregates.pair_distance(g).alias("dist"))


@query("ma6_logistic_score", """WITH w AS (SELECT n_name AS feature, n_nationkey / 10.0::DOUBLE - 1 AS w FROM nation), f AS (SELECT c_custkey, unnest(['BIAS', n_name, c_mktsegment]) AS feature FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, round(sum(coalesce(w, 0)), 6) AS z, round(1 / (1 + exp(-sum(coalesce(w, 0)))), 6) AS p FROM f LEFT JOIN w USING (feature) GROUP BY c_custkey""")
def ma6(spark, d):
    n = table(spark, d, "nation")
    w = n.select(F.col("n_name").alias("feature"), (F.col("n_nationkey") / 10.0 - 1).alias("w"), F.lit(0.0).alias("prior"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array(F.lit("BIAS"), "n_name", "c_mktsegment").alias("f"))
    return learn.score(c, w, ["c_custkey"]).select("c_custkey", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("ml3_train_price_model")
def ml3(spark, d):
    p = table(spark, d, "part").select(F.lit("price").alias("model"), F.col("p_partkey").alias("seq"), F.array(F.lit("bias"), F.when(F.col("p_size") > 25, "grp:yes").otherwise("grp:no"), F.col("p_brand")).alias("f"), (F.col("p_size") > 25).cast("int").alias("y"))
    return learn.train(p)


_KNN = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE id % 10 = 0),
d AS (SELECT q.id, v.id AS near, v.label, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM q JOIN v ON q.id <> v.id)
SELECT id, near, label, round(d, 4) AS d, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), near)::INT AS rank FROM d QUALIFY rank <= 5"""


@query("so4_nearest_shapes", _KNN)
def so4(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return learn.nearest(e.where("id % 10 = 0"), e).select("id", "near", "label", F.round("d", 4).alias("d"), "rank")


@query("ml7_shape_votes", f"WITH k AS ({_KNN}), g AS (SELECT id, label, sum(1 / (0.05 + d)) AS w FROM k GROUP BY ALL) SELECT id, arg_min(label, (-round(w, 6), label)) AS label, round(max(w), 3) AS weight FROM g GROUP BY id")
def ml7(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return learn.vote(learn.nearest(e.where("id % 10 = 0"), e).withColumn("d", F.round("d", 4))).select("id", "label", F.round("weight", 3).alias("weight"))


@query("ar5_dot_products", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS square FROM embeddings")
def ar5(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(learn.dot(F.col("embedding"), F.col("embedding")), 4).alias("square"))


@query("ml1_decisions", """SELECT user_id, CASE WHEN known THEN 'format' ELSE 'model' END AS source, CASE WHEN known THEN s >= 2 AND e <= greatest(1.0, 0.05 * n) AND p > 0 ELSE e = 0 AND p > 0 AND n >= 20 END AS trusted
FROM (SELECT user_id, user_id % 2 = 0 AS known, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY user_id)""")
def ml1(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), of("purchase").alias("p"), of("error").alias("e"), of("signup").alias("s"))
    x = learn.decide(F.col("n"), F.col("p"), F.col("e") == 0, F.col("user_id") % 2 == 0, F.col("s"), F.col("e"), F.col("n") >= 20)
    return g.select("user_id", x["source"].alias("source"), x["trusted"].alias("trusted"))


@query("ml6_template_lessons", """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), t AS (SELECT user_id AS template, count(*) AS checks, count(*) FILTER (WHERE ok) AS agree, max(event_id) AS updated, count(*) FILTER (WHERE f = 0) AS streak FROM (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM e) GROUP BY user_id)
SELECT template, streak, checks, agree, updated FROM t""")
def ml6(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("template"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    empty = spark.createDataFrame([], "template bigint, streak bigint, checks bigint, agree bigint, updated bigint")
    half = learn.learn_template(e.where("seq < 5000"), empty)
    return learn.learn_template(e.where("seq >= 5000"), half)


@query("sm1_sessions", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 180 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS "start", count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM g GROUP BY user_id, k""")
def sm1(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return s.sessions(e, "user_id", "ts", "180 minutes").drop("end")


@query("sm2_ordered_answers", "SELECT conv_id, turn, role FROM conversations")
def sm2(spark, d):
    c = stream(spark, d, "conversations")
    least = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"))
    rows = c.select("conv_id", "turn", "role").join(least, "conv_id").select("conv_id", (F.col("turn") - F.col("first")).alias("turn"), "role")
    out = s.run_available(s.in_order(rows), name="ordered")
    return out.join(least, "conv_id").select("conv_id", (F.col("turn") + F.col("first")).alias("turn"), "role")


@query("sm3_caption_carry", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations")
def sm3(spark, d):
    c = table(spark, d, "conversations").withColumn("caption", F.when(F.col("role") == "user", F.col("text")).otherwise(""))
    return s.caption_carry(c, "conv_id", "turn", "caption").select("conv_id", "turn", "carried")


@query("sm6_pacing", "SELECT event_id, count(*) OVER w AS in_minute, count(*) OVER w <= 2 AS allowed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)")
def sm6(spark, d):
    return s.paced(table(spark, d, "events"), "event_type", "ts", 2).select("event_id", "in_minute", "allowed")


@query("sm6_failover", "SELECT user_id, CASE WHEN v < 20 THEN 'view' WHEN c < 20 THEN 'click' END AS provider FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY user_id)")
def sm6b(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("used"))
    return n.select("user_id", s.failover([("view", 20), ("click", 20)], F.col("used")).alias("provider"))


@query("sm8_stale_buttons", "SELECT e.event_id, coalesce(a.k = e.event_id % 3, false) AS accepted FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id % 3) AS k FROM events WHERE event_type = 'view' GROUP BY ALL) a ON e.user_id = a.user_id AND e.ts >= a.ts")
def sm8(spark, d):
    e = table(spark, d, "events").withColumn("plan", F.col("event_id") % 3)
    plans = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("plan").alias("plan"))
    return s.current_only(e.where("event_type = 'click'").select("event_id", "user_id", "ts", "plan"), plans, "user_id", "plan", "ts").select("event_id", "accepted")


@query("sm9_windows_stream", "SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS \"start\", event_type, count(*) AS n FROM events GROUP BY ALL")
def sm9(spark, d):
    e = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return s.latest(s.run_available(s.windows(e, "ts", "1 day"), "update", "windows"), ["start", "event_type"])


@query("sm10_complete_picks", "SELECT user_id, count(DISTINCT event_type) AS filled, 5::INT AS needed FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 5")
def sm10(spark, d):
    e = table(spark, d, "events").withColumn("needed", F.lit(5))
    return s.complete(e, "user_id", "event_type", "value", None)


@query("sm11_flags_stream", "SELECT user_id, arg_max(event_type = 'purchase', (ts, event_id)) AS flag FROM events GROUP BY user_id")
def sm11(spark, d):
    e = stream(spark, d, "events")
    out = s.run_available(s.flags(e, "user_id", "ts", F.col("event_type") == "purchase"), "update", "flags")
    return s.latest(out, ["user_id"]).select("user_id", "flag")


@query("ml16_group_lessons", "SELECT e.event_id, a.value > 50 AS y FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) a ON e.user_id = a.user_id AND e.ts >= a.ts WHERE a.value IS NOT NULL")
def ml16(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    checked = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    lines = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return orders.group_lessons(lines, checked, ["user_id"], "ts", "value", F.col("value") > 50).select("event_id", "y")


@query("ml18_seed_merge", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand LIKE '%1')")
def ml18(spark, d):
    from ..operators.joins import unseen

    p = table(spark, d, "part")
    return unseen(p.where("p_size > 25").select("p_partkey"), [p.where(F.endswith("p_brand", F.lit("1")))], ["p_partkey"])


@query("ml15_photo_pages", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'known' WHEN count(*) FILTER (WHERE l_discount > 0.09) <= greatest(1, 0.1 * count(*)) THEN 'local' ELSE 'teacher' END AS by FROM lineitem GROUP BY l_orderkey")
def ml15(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("k"), F.count_if(F.col("l_discount") > 0.09).alias("u"), F.count("*").alias("n"))
    return g.select("l_orderkey", orders.photo_route(F.col("k"), F.col("u"), F.col("n")).alias("by"))