"""The price model's features of a number: how it is written, its column, what stands above it and in its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import digit_bucket, digits_of, magnitude, parse_number
from ..functions.text import fold_plain, is_unit, keyword_groups

# Names of separators, currency words, and years that a number of four digits may be.
SEPARATOR_NAMES = {",": "comma", "٬": "comma", "،": "comma", "/": "slash", ".": "dot", "٫": "dot", "'": "quote", "’": "quote"}
CURRENCIES = ("ریال", "تومان", "تومن", "rial", "rials", "toman", "usd", "irr", "دلار", "یورو", "درهم")
YEARS = ((1300, 1499), (1990, 2100))


def _one_of(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out


def _kinds(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: keyword_groups(w)))))


def _near(row: Column, is_kind, heights: float | None = None) -> Column:
    return F.exists(row, lambda w: is_kind(w["word"]) & ((w["gap"] <= heights) if heights is not None else F.lit(True)))


def price_features(nums: DataFrame, keys: list[str]) -> DataFrame:
    """ML2, AG10: (keys, id, f): the feature names of every number, for MA6 and ML3.

    nums: keys (a page), id, col (its column), x0, x1, y0, text, attached, header and above (arrays of folded words: of the
    column's header, straight above the number), row (array of struct<word, gap>: the row's folded words, and how many
    line heights from the number). Column statistics are windows over (keys, col); texts that aren't numbers go."""
    w, page = Window.partitionBy(*keys, "col"), Window.partitionBy(*keys)
    n = nums.withColumn("_p", parse_number(F.col("text"))).where("_p is not null").withColumn("_d", digits_of(F.col("text")))
    n = n.withColumns({"_len": F.length("_d"), "_sep": F.col("_p.group_sep"), "_value": F.col("_p.value"), "_grouped": (F.col("_p.group_sep") != "").cast("int")})
    step = F.col("_value") - F.lag("_value").over(w.orderBy("y0", "id"))
    n = n.withColumns({"_step": (step == 1).cast("int"), "_left": F.min("x0").over(w)})
    n = n.withColumns({
        "_n": F.count("*").over(w), "_share": F.avg("_grouped").over(w), "_mid": F.percentile("_len", 0.5).over(w), "_same": F.min("_len").over(w) == F.max("_len").over(w),
        "_steps": F.coalesce(F.sum("_step").over(w), F.lit(0)), "_thousands": F.avg(F.endswith("_d", F.lit("000")).cast("int")).over(w),
        "_from_left": F.dense_rank().over(page.orderBy("_left")) - 1, "_from_right": F.dense_rank().over(page.orderBy(F.col("_left").desc())) - 1,
    })
    zeros = F.col("_len") - F.length(F.rtrim(F.col("_d"), F.lit("0")))
    grouped, many, value = F.col("_grouped") == 1, F.col("_n") >= 3, F.col("_value")
    separator = _one_of(*((F.col("_sep") == s, name) for s, name in SEPARATOR_NAMES.items()))
    year = F.lit(False)
    for low, high in YEARS:
        year = year | F.col("_d").cast("int").between(low, high)
    said = F.array_distinct(F.concat("header", "above"))
    currencies = sorted({fold_plain(c) for c in CURRENCIES})
    tag = lambda prefix, c: F.concat(F.lit(prefix), c)
    flag = lambda condition, name: F.when(condition, F.lit(name))
    one = [
        F.lit("bias"), tag("digits:", digit_bucket(F.col("_len"))), F.when(grouped, "grp:yes").otherwise("grp:no"), F.when(grouped, tag("sep:", F.coalesce(separator, F.lit("space")))),
        flag(F.col("_p.decimals") > 0, "dec"), tag("script:", F.col("_p.script")), tag("tz:", _one_of((zeros == 0, "0"), (zeros < 3, "1-2"), (zeros >= 3, "3+"))),
        tag("mag:", F.least(magnitude(value), F.lit(12)).cast("string")), flag(F.col("attached"), "attached"), flag(~grouped & (F.col("_len") == 4) & year, "yearlike"),
        tag("coln:", _one_of((F.col("_n") == 1, "1"), (F.col("_n") <= 3, "2-3"), (F.col("_n") < 10, "4-9"), (F.col("_n") >= 10, "10+"))),
        tag("colgrp:", _one_of((F.col("_share") >= 0.8, "hi"), (F.col("_share") >= 0.3, "mid"), (F.col("_share") < 0.3, "lo"))),
        flag(many & (F.col("_share") == 0) & F.col("_same") & (F.col("_len") >= 5), "col_code_like"), flag(many & (F.col("_steps") >= 0.7 * (F.col("_n") - 1)), "col_seq"),
        flag(many & (F.abs(F.col("_len") - F.col("_mid")) >= 2), "len_outlier"), tag("rr:", F.least("_from_right", F.lit(4)).cast("string")), tag("rl:", F.least("_from_left", F.lit(4)).cast("string")),
        flag(many & (F.col("_thousands") >= 0.7), "colk:hi"), flag(F.size("header") == 0, "nohdr"), flag(_near(F.col("row"), lambda w: w.isin(currencies), 5), "cur_adj"),
        flag(_near(F.col("row"), lambda w: F.array_contains(keyword_groups(w), "phone")), "row_phone"), flag(_near(F.col("row"), is_unit, 3.5), "unit_adj"),
    ]
    words = lambda prefix, c, most: F.transform(F.array_distinct(F.filter(F.slice(c, 1, most), lambda x: x != "")), lambda x: tag(prefix, x))
    f = F.concat(F.array_compact(F.array(*one)), F.transform(_kinds(said), lambda k: tag("kw:", k)), words("h:", F.col("header"), 6), words("a:", F.col("above"), 3))
    return n.select(*keys, "id", f.alias("f"))
