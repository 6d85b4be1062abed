"""Whole lists: the language's plans over items, features, groups, grids, state."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text
from ..functions.numbers import digits_of
from ..operators import aggregates, features, groups, joins, layout, learn, orders, pricing, reshape, state
from ..plans.commands import Outcome, Plan, interpret, parse_groups, plan_from_json, read_values
from ..registry import query
from ..sources import files
from ..streaming import events as s
from .base import BOXES, ITEMS, boxes, items, stream, table

# whole cents of a price after a percentage, half up
_AFTER = "((2 * CAST(value * 100 AS BIGINT) * ({f}) + 100) // 200)"


def _changed(rows, plan: Plan):
    return pricing.compute(rows, plan).select("id", F.round(F.col("new").cast("double"), 2).alias("new"))


@query("ql2_group_rules", f"SELECT id, {_AFTER.format(f='CASE grp WHEN $$Brand#11$$ THEN 112 WHEN $$Brand#22$$ THEN 95 WHEN $$Brand#33$$ THEN 95 ELSE 103 END')} / 100.0::DOUBLE AS new FROM {ITEMS}".replace("$$", "'"))
def ql2(spark, d):
    plan = parse_groups("Brand#11 12% increase, Brand#22 Brand#33 5% decrease, rest 3% increase", ["Brand#11", "Brand#22", "Brand#33"]).plan
    return _changed(items(spark, d), plan)


@query("ql3_bound_groups", f"SELECT id, (CASE grp WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 END)::INT AS rule FROM {ITEMS}")
def ql3(spark, d):
    plan = parse_groups("Brand#11 12% increase, Brand#12 7% increase", ["Brand#11", "Brand#12", "Brand#13"]).plan
    it = items(spark, d)
    return it.select("id", pricing.chosen_rule(plan, F.col("grp"), F.col("id").cast("string"))["ord"].alias("rule"))


@query("ql4_remote_plan", f"SELECT id, CASE WHEN id IN (2, 4) THEN 7.0::DOUBLE ELSE {_AFTER.format(f='104')} / 100.0::DOUBLE END AS new FROM {ITEMS}")
def ql4(spark, d):
    answer = {"rules": [{"op": "percent", "value": 4, "scope": "all"}, {"op": "set", "value": 7, "ids": ["2", "4", "none"]}, {"op": "double", "value": 2, "scope": "all"}, {"op": "add", "value": "much", "scope": "all"}], "rounding": {"mode": "sideways"}}
    return _changed(items(spark, d), plan_from_json(json.dumps(answer), "", {"2", "4"}))


@query("ql5_other_rounding", f"SELECT id, new FROM (SELECT id, value::DOUBLE AS old, (ceil(CAST(value * 100 AS BIGINT) * 110 / 1000000.0::DOUBLE) * 100)::DOUBLE AS new FROM {ITEMS}) WHERE new <> old")
def ql5(spark, d):
    plan = interpret("10% increase, round 50").plan.with_rounding(100, "up")
    return _changed(items(spark, d), plan)


@F.pandas_udf(ArrayType(StringType()))
def _values(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [(read_values(t, 3)[0] or {}).get(i, "") for i in range(3)])


@query("ql7_view_values", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['', '', v] WHEN 1 THEN [v, '', '5'] WHEN 2 THEN [v || 'K', v || 'K', v || 'K'] ELSE ['', v || 'M', ''] END AS v FROM (SELECT event_id, (event_id % 90 + 1)::VARCHAR AS v FROM events)""")
def ql7(spark, d):
    n = (F.col("event_id") % 90 + 1).cast("string")
    said = F.element_at(F.array(n, F.concat(F.lit("top "), n, F.lit(" bottom 5")), F.concat(F.lit("all "), n, F.lit("k")), F.concat(F.lit("row 2 "), n, F.lit("m"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", _values(said).alias("v"))


_COMMANDS = ("10% increase", "Brand#11 10% increase", "Brand#11 above 500 10% increase", "row 3 10% increase", "15%", "10 تومان افزایش", "۱۰ درصد افزایش روی لنت ها", "Brand#11 and Brand#12 5%, decrease")


@F.pandas_udf(StringType())
def _routed(commands: pd.Series) -> pd.Series:
    def kind(c: str) -> str:
        out: Outcome = interpret(c, ["Brand#11", "Brand#12"])
        return out.kind if out.plan is None else f"{out.kind}:{len(out.plan.rules)}:{'all' if out.plan.rules[0].groups is None else 'groups'}"

    return commands.map(kind)


@query("ql8_routing", "SELECT p_partkey, (['ok:1:all', 'ok:1:groups', 'remote', 'remote', 'direction', 'remote', 'remote', 'ok:1:groups'])[p_partkey % 8 + 1] AS kind FROM part".replace("'ok:1:groups', 'remote', 'remote', 'direction'", "'ok:1:groups', 'ok:1:groups', 'remote', 'direction'"))
def ql8(spark, d):
    c = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", _routed(c).alias("kind"))


@query("ag3_last_rule", f"SELECT id, (CASE WHEN id % 5 = 0 AND grp = 'Brand#11' THEN 2 WHEN grp = 'Brand#11' THEN 1 ELSE 0 END)::INT AS rule FROM {ITEMS}")
def ag3(spark, d):
    it = items(spark, d)
    schema = "ord int, scope string, groups array<string>, op string, operand decimal(12,4)"
    rules = spark.createDataFrame([(0, "all", None, "percent", Decimal(5)), (1, "groups", ["Brand#11"], "percent", Decimal(10))], schema).withColumn("ids", F.lit(None).cast("array<bigint>"))
    own = it.where("id % 5 = 0 and grp = 'Brand#11'").select(F.lit(2).alias("ord"), F.lit("ids").alias("scope"), F.lit(None).cast("array<string>").alias("groups"), F.lit("set").alias("op"), F.lit(7).cast("decimal(12,4)").alias("operand"), F.array("id").alias("ids"))
    return pricing.join_rules(it, rules.unionByName(own)).select("id", F.col("rule.ord").alias("rule"))


@query("ml2_price_features")
def ml2(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    head = F.element_at(F.array(F.array(F.lit("price")), F.array(F.lit("code"), F.lit("no")), F.array().cast("array<string>")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    row = F.array(F.struct(F.element_at(F.array(F.lit("toman"), F.lit("kg"), F.lit("tel")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("word"), (F.col("l_quantity") % 6).alias("gap")))
    number = F.format_number(F.col("l_extendedprice"), 0)
    shown = F.when(F.col("l_linenumber") % 2 == 0, number).otherwise(F.col("l_partkey").cast("string"))
    nums = l.select(F.floor(F.col("l_orderkey") / 32).alias("page"), F.monotonically_increasing_id().alias("_"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("col"), (F.col("l_linenumber") * 10.0).alias("x0"), (F.col("l_linenumber") * 10.0 + 8).alias("x1"), F.col("l_orderkey").cast("double").alias("y0"), shown.alias("text"), (F.col("l_tax") > 0.07).alias("attached"), head.alias("header"), F.array().cast("array<string>").alias("above"), row.alias("row"))
    return features.price_features(nums, ["page"]).select("page", "id", F.array_sort("f").alias("f"))


@query("ml4_title_features")
def ml4(spark, d):
    e = table(spark, d, "events")
    y = F.col("event_id").cast("double") * 10
    lines = e.select(
        F.floor(F.col("event_id") / 50).alias("page"), F.col("event_id").alias("id"), F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("text"), (F.col("event_id") % 7 * 10.0).alias("x0"), (F.col("event_id") % 7 * 10.0 + 40).alias("x1"), y.alias("y0"),
        (y + 8).alias("y1"), F.lit(8.0).alias("h"), (F.col("event_type") == "purchase").cast("int").alias("n_prices"), (F.col("event_type") == "signup").alias("is_header"), F.lit(2).alias("words"), (F.col("event_id") % 3 + 1).alias("chunks"), (F.col("event_id") % 9).alias("row_no"),
    )
    return groups.title_features(lines, ["page"]).select("page", "id", F.array_sort("f").alias("f"))


@query("jo9_grid_lines", f"""WITH a AS (SELECT page, id, x0 / 100 AS pos FROM (SELECT DISTINCT page, id, x0 FROM {BOXES})), n AS (SELECT page, count(*) AS n FROM a GROUP BY page)
SELECT page, n AS matched, 1.0::DOUBLE AS likeness, true AS same FROM n""")
def jo9(spark, d):
    b = boxes(spark, d).select("page", "id", "x0").distinct().select("page", "id", F.lit(False).alias("across"), (F.col("x0") / 100).alias("pos"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    moved = b.withColumns({"pos": F.col("pos") + 0.004, "start": F.col("start") + 0.02, "id": F.col("id") + 100})
    return joins.grid_likeness(b, moved, "page")


@query("jo11_known_layouts", f"""WITH a AS (SELECT DISTINCT page, id, x0 / 100 AS pos FROM {BOXES}), n AS (SELECT page, count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS m FROM a GROUP BY page)
SELECT page, m AS matched, m / n::DOUBLE AS likeness, m >= 0.95 * n AS same FROM n WHERE m > 0""")
def jo11(spark, d):
    b = boxes(spark, d).select("page", "id", "x0").distinct().select("page", "id", F.lit(True).alias("across"), (F.col("x0") / 100).alias("pos"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    return joins.grid_likeness(b, b.where("id % 2 = 0"), "page")


@query("pr5_column_names", f"""SELECT page, id AS col, string_agg(flag, ' ' ORDER BY y0 DESC) AS header FROM (SELECT *, max(y0) OVER (PARTITION BY page, id) AS top FROM {BOXES}) WHERE false GROUP BY page, id UNION ALL
SELECT DISTINCT page, id, 'x' || id FROM {BOXES}""")
def pr5(spark, d):
    b = boxes(spark, d).groupBy("page", "id").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    words = b.select("page", "x0", "x1", F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    columns = b.select("page", F.col("id").alias("col"), "x0", "x1", F.lit(2.0).alias("y0"))
    return layout.headers(words, columns, ["page"], 1.0)


@query("pr14_usage_lines", """SELECT day, model, model || ': ' || requests || ' of 40, ' || CASE WHEN exhausted THEN 0 ELSE greatest(0, 40 - requests) END || ' left' || CASE WHEN exhausted THEN ' (used up)' ELSE '' END || '; tokens ' || tin || ' in, ' || tout || ' out' AS line FROM (
SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS requests, sum(user_id)::BIGINT AS tin, sum(event_id)::BIGINT AS tout, bool_or(user_id % 97 = 0) AS exhausted FROM events GROUP BY ALL)""")
def pr14(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), "ts", F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"), (F.col("user_id") % 97 == 0).alias("exhausted"))
    limits = e.select("model").distinct().withColumn("per_day", F.lit(40))
    return state.usage_report(aggregates.usage_by_day(e, F.to_date("ts")), limits)


@query("pr15_tidy_headers", "SELECT DISTINCT l_orderkey AS page, l_linenumber AS col, CASE WHEN l_linenumber % 2 = 0 THEN 'column ' || l_linenumber ELSE 'price net' END AS name FROM lineitem")
def pr15(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("col")).distinct()
    c = c.withColumn("header", F.when(F.col("col") % 2 == 0, F.array(F.lit("bolts"), F.lit("--"))).otherwise(F.array(F.lit("price"), F.lit("bolts"), F.lit("net"))))
    return groups.tidy_headers(c, c.select("page", F.lit("bolts").alias("word")), ["page"])


@query("sm7_hand_off", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 OR event_id % 5 >= 3 THEN 'fail' ELSE 'resubmit' END AS action, event_id % 5 + CASE WHEN event_id % 4 = 0 OR event_id % 5 >= 3 THEN 0 ELSE 1 END AS tries FROM events")
def sm7(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 4 == 0).alias("started"), (F.col("event_id") % 5).alias("tries"))
    return state.hand_off(jobs).select("id", "action", "tries")


@query("sm9_sliding_windows", "SELECT \"start\", event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP)) - INTERVAL 6 HOUR * k AS \"start\", event_type FROM events, range(2) r(k)) GROUP BY ALL")
def sm9_sliding(spark, d):
    return s.windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", "6 hours")


@query("sm9_stream_join", "SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def sm9_join(spark, d):
    def side(kind: str):
        e = stream(spark, d, "events")
        return e.where(F.col("event_type") == kind).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))

    return s.run_available(s.joined(side("view"), side("purchase"), "user_id", "1 day", "400 days"), "append", "joined")


@query("sm12_ticks", "SELECT event_id, time_bucket(INTERVAL 300 SECOND, CAST(ts AS TIMESTAMP)) AS tick FROM events")
def sm12(spark, d):
    return table(spark, d, "events").select("event_id", state.tick(F.col("ts")).alias("tick"))


@query("sc16_updates", "SELECT event_id AS update_id, user_id AS chat, CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'file' ELSE 'button' END AS kind, CASE WHEN event_id % 3 = 1 THEN 'f' || event_id END AS file_id FROM events WHERE event_id > 100")
def sc16(spark, d):
    chat = F.struct(F.col("user_id").alias("id"))
    e = table(spark, d, "events").select("event_id", "user_id")
    message = F.struct(F.col("event_id").alias("message_id"), chat.alias("chat"), F.when(F.col("event_id") % 3 == 0, "hello").alias("text"), F.when(F.col("event_id") % 3 == 1, F.struct(F.concat(F.lit("f"), F.col("event_id")).alias("file_id"))).alias("document"))
    button = F.struct(F.lit("x").alias("data"), F.struct(F.col("event_id").alias("message_id"), chat.alias("chat")).alias("message"))
    raw = e.select(F.to_json(F.struct(F.col("event_id").alias("update_id"), F.when(F.col("event_id") % 3 < 2, message).alias("message"), F.when(F.col("event_id") % 3 == 2, button).alias("callback_query"))).alias("value"))
    return files.chat_updates(raw.unionByName(raw), after=100).select("update_id", "chat", "kind", "file_id")


@query("ag27_rereading", """WITH t AS (SELECT p_partkey AS target, 1000 + p_partkey % 7 AS a, 1000 + p_partkey % 5 AS b, 1000 + p_partkey % 3 AS c FROM part)
SELECT target, (CASE WHEN a = b THEN a WHEN c = a OR c = b THEN c END)::VARCHAR AS text FROM t WHERE a = b OR c = a OR c = b""")
def ag27b(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("target"))
    said = lambda m: (1000 + F.col("target") % m).cast("string")
    votes = p.select("target", F.lit(1).alias("vote_ord"), F.lit("r1").alias("reader"), said(7).alias("text")).unionByName(p.select("target", F.lit(2).alias("vote_ord"), F.lit("r2").alias("reader"), said(5).alias("text")))
    readers = spark.createDataFrame([("r1", 0), ("r2", 1), ("r3", 2)], "reader string, reader_ord int")
    settled, _ = aggregates.reread(p, readers, votes, lambda asked, n: asked.withColumn("text", F.when(F.col("reader") == "r3", said(3)).otherwise(said(7))), rounds=1)
    return settled.select("target", digits_of(F.col("text")).alias("text"))


@query("se5_restored", "SELECT DISTINCT ON (user_id, lot) user_id, lot FROM (SELECT user_id, event_id // 20 AS lot FROM events)")
def se5b(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 20).alias("lot"))
    side = lambda n: e.where(F.col("event_id") % 2 == n).select("user_id", "lot")
    return state.restore(side(1).distinct(), side(0), ["user_id", "lot"])


@query("ar4_unit_vectors", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS length FROM embeddings")
def ar4(spark, d):
    e = table(spark, d, "embeddings")
    v = learn.normalised(F.transform("embedding", lambda x: x.cast("double")))
    return e.select(F.col("vec_id").alias("id"), F.round(learn.dot(v, v), 6).alias("length"))


@query("se9_page_cascade", "SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_type = 'error'), min(event_id) FILTER (WHERE event_type = 'signup'), min(event_id)) AS first FROM events GROUP BY user_id")
def se9(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    part = lambda c: e.where(c).select("user_id", "event_id")
    return joins.cascade([part("event_type = 'error'"), part("event_type = 'signup'"), part("true")], ["user_id"]).groupBy("user_id").agg(F.min("event_id").alias("first"))


@query("se2_header_period", "SELECT p_partkey, 3::INT AS period FROM part")
def se2(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lit(reshape.header_period(["code", "name", "price"] * 3)).alias("period"))


@query("st6_units", "SELECT p_partkey, replace(p_name, 'fi', 'fi') AS t FROM part")
def st6(spark, d):
    return table(spark, d, "part").select("p_partkey", text.units(F.replace(F.col("p_name"), F.lit("fi"), F.lit("ﬁ"))).alias("t"))


@query("sc22_covered_columns", f"SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY id) AS col, x0, x1 FROM (SELECT DISTINCT page, id, x0, x1 FROM {BOXES})")
def sc22(spark, d):
    words = boxes(spark, d).select("page", F.col("y0").alias("row"), "x0", "x1")
    return orders.coverage_columns(words, ["page"], 1.0)


@query("sc20_number_runs", "SELECT p_partkey, string_split(p_name, ' ')[1] || '' AS first, (p_size * 7)::VARCHAR AS text FROM part".replace("string_split(p_name, ' ')[1] || '' AS first", "0.0::DOUBLE AS first"))
def sc20_runs(spark, d):
    shown = F.concat((F.col("p_size") * 7).cast("string"), F.lit("/x"))
    glyphs = table(spark, d, "part").select("p_partkey", F.posexplode(F.split(shown, "")).alias("n", "text")).where("text <> ''")
    glyphs = glyphs.select("p_partkey", "text", (F.col("n") * 5.0).alias("x0"), (F.col("n") * 5.0 + 5).alias("x1"), F.lit(10.0).alias("size"))
    return orders.number_runs(glyphs, ["p_partkey"])


_SIDE = "(SELECT DISTINCT page, id, x0, y0, x1, y1 FROM " + BOXES + " WHERE flag {f} 'R')"


@query("jo19_outside_titles", f"SELECT * FROM {_SIDE.format(f='<>')} w WHERE NOT EXISTS (SELECT 1 FROM {_SIDE.format(f='=')} t WHERE t.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN t.x0 - 15 AND t.x1 + 15 AND (w.y0 + w.y1) / 2 BETWEEN t.y0 AND t.y1)")
def jo19(spark, d):
    b = boxes(spark, d)
    side = lambda c: b.where(c).select("page", "id", "x0", "y0", "x1", "y1").distinct()
    titles = side("flag = 'R'").withColumns({"x0": F.col("x0") - 15, "x1": F.col("x1") + 15})
    return layout.not_in_titles(side("flag <> 'R'"), titles, ["page"], 8.0)


@query("sk12_merged_rows", f"""WITH b AS (SELECT DISTINCT page, y0, y1 FROM {BOXES}), s AS (SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT page, min(y0) AS y0, max(y1) AS y1 FROM g GROUP BY page, k""")
def sk12_rows(spark, d):
    across = boxes(spark, d).select("page", F.lit(0.0).alias("x0"), "y0", F.lit(0.0).alias("x1"), "y1")  # a row goes across its page
    return aggregates.merge_boxes(across.unionByName(across)).select("page", "y0", "y1")
