"""Words, names, JSON, arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, layout, orders
from ..registry import query
from ..sources import files
from .base import table


@query("st1_canon", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9_%$#]', '', 'g') AS word FROM part")
def st1(spark, d):
    return table(spark, d, "part").select("p_partkey", text.canon(F.col("p_name")).alias("word"))


@query("st2_name_keys", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', ' ', 'g')) AS key, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS tight FROM part")
def st2(spark, d):
    return table(spark, d, "part").select("p_partkey", text.name_key(F.col("p_type")).alias("key"), text.compact(F.col("p_type")).alias("tight"))


@query("st3_normalize_command", "SELECT conv_id, turn, trim(lower(regexp_replace(replace(text, '،', ','), '\\s+', ' ', 'g'))) AS t FROM conversations")
def st3(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalize_command(F.col("text")).alias("t"))


@query("st4_visual_order")
def st4(spark, d):
    return table(spark, d, "part").select("p_partkey", text.visual_to_logical(F.reverse(F.concat(F.lit("دنده "), F.col("p_name"))), F.array(F.lit("دنده"))).alias("t"))


@query("st5_bracket_repair")
def st5(spark, d):
    return table(spark, d, "part").select("p_partkey", text.pair_brackets(F.concat(F.lit(")"), F.col("p_name"), F.lit("("))).alias("t"))


@query("st7_same_name", """SELECT a, b, a = b OR (length(s) >= 3 AND contains(l, s) AND length(s) * 10 >= length(l) * 6) AS same FROM (
SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM (SELECT DISTINCT lower(replace(p_type, ' ', '')) AS a FROM part), (SELECT DISTINCT lower(replace(n_name, ' ', '')) AS b FROM nation))""")
def st7(spark, d):
    a = table(spark, d, "part").select(text.tight(text.name_key(F.col("p_type"))).alias("a")).distinct()
    b = table(spark, d, "nation").select(text.tight(text.name_key(F.col("n_name"))).alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", text.same_name(F.col("a"), F.col("b")).alias("same"))  # 25 nations


@query("st8_likeness", """WITH n AS (SELECT n_nationkey AS k, lower(replace(n_name, ' ', '')) AS t FROM nation),
g AS (SELECT k, substr(t, i::INT, 2) AS g, count(*) AS c FROM n, generate_series(1, 40) s(i) WHERE i < length(t) GROUP BY ALL)
SELECT a.k AS a, b.k AS b, round(2.0 * coalesce((SELECT sum(least(x.c, y.c)) FROM g x JOIN g y ON x.g = y.g WHERE x.k = a.k AND y.k = b.k), 0) / (length(a.t) - 1 + length(b.t) - 1), 6)::DOUBLE AS likeness FROM n a, n b""")
def st8(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), text.name_key(F.col("n_name")).alias("t"))
    m = n.select(F.col("k").alias("b"), F.col("t").alias("u"))
    return n.crossJoin(m).select(F.col("k").alias("a"), "b", F.round(text.likeness(F.col("t"), F.col("u")), 6).alias("likeness"))  # 25 by 25


@query("st9_digit_style")
def st9(spark, d):
    return table(spark, d, "part").select("p_partkey", text.digit_style(True)(F.concat(F.col("p_brand"), F.lit(" پراید "), F.col("p_size").cast("string"), F.lit(" x"), F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 5 == 0, "code").otherwise("name")).alias("t"))


@query("st10_no_errors", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ' —' ELSE p_brand || ' ok' END AS t FROM part")
def st10(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" #n/a"))).otherwise(F.concat("p_brand", F.lit(" ok")))
    return table(spark, d, "part").select("p_partkey", text.no_errors(t).alias("t"))


@query("st11_subtitles", "SELECT p_partkey, CASE WHEN length(t) <= 40 THEN t END AS text, CASE WHEN length(t) > 40 THEN 'too long' END AS error FROM (SELECT p_partkey, trim(p_name || ' ' || p_type) AS t FROM part)")
def st11(spark, d):
    s = text.clean_subtitle(F.concat_ws("  ", "p_name", "p_type"), 40)
    return table(spark, d, "part").select("p_partkey", s["text"].alias("text"), s["error"].alias("error"))


@query("st12_plurals", "SELECT p_partkey, 'پراید' AS w FROM part")
def st12(spark, d):
    w = F.element_at(F.array(*map(F.lit, ("پرایدها", "پرایدهای", "پراید"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.strip_plural(w).alias("w"))


@query("st13_sheet_names", "SELECT p_partkey, t || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS sheet FROM (SELECT p_partkey, p_type AS t, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)")
def st13(spark, d):
    p = table(spark, d, "part").withColumn("t", text.sheet_name(F.col("p_type"), 60))
    k = F.row_number().over(Window.partitionBy("t").orderBy("p_partkey"))
    return p.withColumn("k", k).select("p_partkey", F.concat("t", F.when(F.col("k") > 1, F.concat(F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise("")).alias("sheet"))


@query("st14_json_in_prose", "SELECT event_id, props AS found FROM events WHERE props IS NOT NULL")
def st14(spark, d):
    e = table(spark, d, "events").where("props is not null")
    return e.select("event_id", text.json_in(F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))).alias("found"))


@query("st15_quota_errors", "SELECT event_id, (event_id % 50)::INT AS quota, (event_id % 7)::DOUBLE AS delay, event_id % 2 = 0 AS daily FROM events")
def st15(spark, d):
    msg = F.concat(F.lit("429 quotaValue: '"), (F.col("event_id") % 50).cast("string"), F.lit("', retryDelay: '"), (F.col("event_id") % 7).cast("string"), F.lit("s' "), F.when(F.col("event_id") % 2 == 0, "PerDay").otherwise("PerMinute"))
    q = text.quota_info(msg)
    return table(spark, d, "events").select("event_id", q["limit"].alias("quota"), q["delay"].alias("delay"), q["daily"].alias("daily"))


@query("st16_footer_masks", "SELECT event_id, regexp_matches(h, '^([01][0-9]|2[0-3]):[0-5][0-9]$') AS time_ok, true AS views_ok FROM (SELECT event_id, lpad((event_id % 30)::VARCHAR, 2, '0') || ':' || lpad((event_id % 70)::VARCHAR, 2, '0') AS h FROM events)")
def st16(spark, d):
    from ..functions.numbers import format_views

    h = F.concat(F.lpad((F.col("event_id") % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 70).cast("string"), 2, "0"))
    return table(spark, d, "events").select("event_id", text.time_ok(h).alias("time_ok"), text.views_ok(format_views(F.col("event_id") * 37)).alias("views_ok"))


@query("fi4_legacy_text", "SELECT p_partkey, p_size % 2 = 0 AS legacy FROM part")
def fi4(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("" * 40), F.col("p_brand"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.is_legacy(t).alias("legacy"))


@query("fi5_line_kinds", "SELECT p_partkey, p_partkey % 4 = 0 AS title, p_partkey % 4 = 1 AS note, p_partkey % 4 = 2 AS price_note, p_partkey % 4 = 3 AS supplier FROM part")
def fi5(spark, d):
    lines = ("price list {}", "* {}", "with vat {}", "www {}")
    t = F.element_at(F.array(*(F.concat(*(F.lit(x) if x else F.lit("x") for x in (s.replace("{}", ""),))) for s in lines)), (F.col("p_partkey") % 4 + 1).cast("int"))
    k = text.line_kind(F.concat(t, F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", *(k[c].alias(c) for c in ("title", "note", "price_note", "supplier")))


@query("fi6_keyword_groups", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'code' WHEN 2 THEN 'qty' ELSE '' END AS kinds FROM part")
def fi6(spark, d):
    w = F.element_at(F.array(*map(F.lit, ("Amounts", "Barcode", "تعداد", "zzz"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.keyword_groups(text.canon(w)), ",").alias("kinds"))


@query("fi7_units", "SELECT p_partkey, p_partkey % 3 <> 2 AS unit FROM part")
def fi7(spark, d):
    w = F.element_at(F.array(*map(F.lit, ("kg", "inck", "kgg"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.is_unit(text.canon(w)).alias("unit"))


@query("ag18_vocabulary", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def ag18(spark, d):
    return orders.vocabulary(table(spark, d, "part"), "p_name")


@query("sc20_number_tokens", "SELECT conv_id, turn, len(regexp_extract_all(text, '[0-9]([0-9,٬،/.''’٫]*[0-9])?')) AS n FROM conversations")
def sc20(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(files.number_tokens(F.col("text"))).cast("long").alias("n"))


@query("sc19_page_modes", "SELECT l_orderkey, CASE WHEN n > 0 THEN 'text' WHEN c > 0.02 THEN 'raster' ELSE 'empty' END AS mode, n = 0 AND c > 0.3 AS warn FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, round(sum(l_discount), 6) AS c FROM lineitem GROUP BY l_orderkey)")
def sc19(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.round(F.sum("l_discount"), 6).alias("c"))
    m = files.page_mode(F.col("n"), F.col("c"))
    return g.select("l_orderkey", m["mode"].alias("mode"), m["warn"].alias("warn"))


@query("sc1_file_kinds", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' END AS kind FROM part")
def sc1(spark, d):
    head = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(b"\x00\x01"), F.lit(b"%PDF-1.7"))).when(F.col("p_partkey") % 3 == 1, F.lit(b"\x89PNG\r\n\x1a\n")).otherwise(F.lit(b"hello"))
    return table(spark, d, "part").select("p_partkey", files.file_kind(head).alias("kind"))


@query("sc9_landed_answers", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS first_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'IRR' END AS currency FROM events")
def sc9(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.concat(F.lit('{"currency":"IRR","text_prices":[{"id":'), F.col("event_id").cast("string"), F.lit("}]}")))
    a = files.landed_answers(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", "currency string, text_prices array<struct<id:long>>")
    return a.select("event_id", F.col("answer.text_prices")[0]["id"].alias("first_id"), F.col("answer.currency").alias("currency"))


@query("sc26_newest_model", "SELECT 'pro-latest' AS name, true AS can_generate")
def sc26(spark, d):
    m = table(spark, d, "region").select(F.element_at(F.array(*map(F.lit, ("pro-2.5", "pro-latest", "pro-3.0-preview", "lite-2.0", "embed"))), F.col("r_regionkey") + 1).alias("name"), (F.col("r_regionkey") < 4).alias("can_generate"))
    return files.newest_model(m)


@query("sc21_longest_spans")
def sc21(spark, d):
    w = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("line"), F.row_number().over(Window.partitionBy(F.floor(F.col("l_orderkey") / 16)).orderBy("l_orderkey", "l_linenumber", "l_partkey")).alias("ord"), F.col("l_returnflag").alias("text"))
    known = spark.createDataFrame([("AN",), ("N",), ("RRA",)], "text string")
    return files.longest_spans(w, ["line"], known, 3)


@query("ar1_feature_arrays", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 25 THEN 'big' END, CASE WHEN p_retailprice >= 950 THEN 'dear' END, CASE WHEN p_brand LIKE '%1' THEN 'one' END], lambda x: x IS NOT NULL), ',') AS f FROM part")
def ar1(spark, d):
    f = {"big": F.col("p_size") > 25, "dear": F.col("p_retailprice") >= 950, "one": F.endswith("p_brand", F.lit("1"))}
    return table(spark, d, "part").select("p_partkey", F.array_join(layout.feature_array(f), ",").alias("f"))


@query("ar6_count_maps", "SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def ar6(spark, d):
    m = orders.count_maps(table(spark, d, "events"), ["user_id"], "event_type")
    return m.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("counts"))


@query("jo15_template_columns", """WITH c AS (SELECT p_brand AS doc, p_size % 5 AS col, min(p_partkey % 100)::DOUBLE AS lo, max(p_partkey % 100)::DOUBLE AS hi FROM part GROUP BY ALL)
SELECT a.doc, a.col, b.col AS tpl FROM c a JOIN c b ON a.doc = b.doc AND b.col <> a.col AND greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) > 0 QUALIFY row_number() OVER (PARTITION BY a.doc, a.col ORDER BY greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) DESC, b.col) = 1""")
def jo15(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("doc"), (F.col("p_size") % 5).alias("col")).agg(F.min(F.col("p_partkey") % 100).cast("double").alias("lo"), F.max(F.col("p_partkey") % 100).cast("double").alias("hi"))
    b = c.select("doc", F.col("col").alias("tpl"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    s = c.join(b, "doc").withColumn("s", F.greatest(F.lit(0.0), F.least("hi", "hi2") - F.greatest("lo", "lo2"))).where("s > 0 and tpl <> col")
    return joins.best_by(s, ["doc", "col"], F.col("s"), [F.col("tpl")]).select("doc", "col", "tpl")
