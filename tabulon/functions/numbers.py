"""Numbers in lists: digit scripts, parsing, formatting, rules and rounding, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of the three scripts, separators of digit groups.
LATIN = "0123456789"
PERSIAN = "۰۱۲۳۴۵۶۷۸۹"
ARABIC = "٠١٢٣٤٥٦٧٨٩"
MARKS = ",٬،/.'’٫"
SPACES = "     "

_ANY_DIGIT = f"[{LATIN}{PERSIAN}{ARABIC}]"
_SEPARATOR = f"[{MARKS}{SPACES}]"
MONEY = "decimal(38,6)"


def latin_digits(c: Column) -> Column:
    """PR2: digits of any script as Latin ones."""
    return F.translate(c, PERSIAN + ARABIC, LATIN * 2)


def in_script(c: Column, script: Column) -> Column:
    """PR2: Latin digits written in a script."""
    return F.when(script == "persian", F.translate(c, LATIN, PERSIAN)).when(script == "arabic", F.translate(c, LATIN, ARABIC)).otherwise(c)


def _count(c: Column, digits: str) -> Column:
    return F.length(c) - F.length(F.translate(c, digits, ""))


def digit_script(c: Column) -> Column:
    """PR3: the script most digits are of; on a tie latin before persian before arabic."""
    n = {name: _count(c, digits) for name, digits in (("latin", LATIN), ("persian", PERSIAN), ("arabic", ARABIC))}
    return F.when((n["latin"] >= n["persian"]) & (n["latin"] >= n["arabic"]), "latin").when(n["persian"] >= n["arabic"], "persian").otherwise("arabic")


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_number(c: Column) -> Column:
    """MA1: struct(value, script, group_sep, decimal_sep, decimals), or null for what isn't one clean number. The text is
    cleaned and cut into digit groups and separators once; all cases read these."""
    kept = F.regexp_replace(c, f"[^{LATIN}{PERSIAN}{ARABIC}{MARKS}{SPACES}]", "")
    kept = F.regexp_replace(kept, f"^{_SEPARATOR}+|{_SEPARATOR}+$", "")

    def pieces(kept: Column) -> Column:
        text = F.regexp_replace(latin_digits(kept), rf"[{SPACES}]*([{MARKS}])[{SPACES}]*", "$1")
        return bound(F.regexp_replace(text, f"[{SPACES}]+", " "), lambda t: F.struct(kept.alias("kept"), F.regexp_extract_all(t, F.lit(r"(\d+)")).alias("groups"), F.regexp_extract_all(t, F.lit(r"([^\d]+)")).alias("seps")))

    return bound(bound(kept, pieces), _read_pieces)


def _read_pieces(p: Column) -> Column:
    kept, groups, seps = p["kept"], p["groups"], p["seps"]
    kinds = F.array_distinct(seps)
    first, last = F.length(groups[0]), F.length(F.element_at(groups, -1))
    rest = F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0)))
    threes = F.forall(rest, lambda g: F.length(g) == 3)
    but_last = F.forall(F.slice(groups, 2, F.greatest(F.size(groups) - 2, F.lit(0))), lambda g: F.length(g) == 3)
    before = F.slice(seps, 1, F.greatest(F.size(seps) - 1, F.lit(0)))
    final = F.element_at(seps, -1)
    short = first.between(1, 3)
    joined = F.array_join(groups, "")
    with_point = F.concat(F.array_join(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), ""), F.lit("."), F.element_at(groups, -1))

    def found(digits: Column, group: Column, point: Column, decimals: Column) -> Column:
        return F.struct(digits.try_cast(MONEY).alias("value"), digit_script(kept).alias("script"), group.alias("group_sep"), point.alias("decimal_sep"), decimals.cast("int").alias("decimals"))

    none, zero = F.lit(""), F.lit(0)
    times = lambda k: F.size(F.filter(seps, lambda s: s == k))
    common = F.when(F.array_contains(kinds, ","), F.lit(",")).when(times(kinds[0]) >= times(kinds[1]), kinds[0]).otherwise(kinds[1])
    shape = (F.size(groups) > 0) & (F.size(seps) == F.size(groups) - 1) & F.forall(seps, lambda s: F.length(s) == 1)
    return (
        F.when(~shape, F.lit(None))
        .when(F.size(seps) == 0, found(joined, none, none, zero))
        .when((F.size(kinds) == 1) & short & threes, found(joined, seps[0], none, zero))
        .when((F.size(seps) == 1) & seps[0].isin(*",٬،/") & (first >= 4) & (last == 3), found(joined, seps[0], none, zero))
        .when((F.size(seps) == 1) & (seps[0] != " ") & last.between(1, 4), found(with_point, none, seps[0], last))
        .when((F.size(kinds) == 2) & short & threes & ~F.array_contains(kinds, " "), found(joined, common, none, zero))
        .when(
            (F.size(kinds) == 2) & ~F.array_contains(before, final) & (F.size(F.array_distinct(before)) == 1) & (final != " ") & short & but_last & last.between(1, 4),
            found(with_point, seps[0], final, last),
        )
    )


def grouped(digits: Column, sep: Column) -> Column:
    """Digits in threes, with a separator between."""
    marked = F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", "\u0001")
    return F.when(sep == "", digits).otherwise(F.replace(marked, F.lit("\u0001"), sep))


def format_number(value: Column, script: Column, group_sep: Column, decimal_sep: Column, decimals: Column) -> Column:
    """PR1: a decimal in its own style; half rounds up, away from zero."""
    scaled = F.round(F.abs(value.cast(MONEY)) * F.pow(F.lit(10), decimals).cast("decimal(10,0)"), 0).cast("decimal(38,0)").cast("string")
    padded = F.lpad(scaled, F.greatest(F.length(scaled), decimals + 1), "0")
    whole, part = F.substring(padded, F.lit(1), F.length(padded) - decimals), F.right(padded, decimals)
    point = F.when(decimal_sep == "", F.lit(".")).otherwise(decimal_sep)
    text = F.concat(F.when(value < 0, "-").otherwise(""), grouped(whole, group_sep), F.when(decimals > 0, F.concat(point, part)).otherwise(""))
    return in_script(text, script)


def looks_like_price(parsed: Column) -> Column:
    """FI1: written in groups, and 1000 or more."""
    return F.coalesce((parsed["group_sep"] != "") & (parsed["value"] >= 1000), F.lit(False))


def digits_of(c: Column) -> Column:
    """The Latin digits of a text, nothing else."""
    return F.regexp_replace(latin_digits(c), r"[^0-9]", "")


def is_candidate(text: Column, attached: Column) -> Column:
    """FI2: not glued to letters, two digits at least."""
    return ~attached & (F.length(digits_of(text)) >= 2)


def ocr_number(c: Column) -> Column:
    """MA2: a word read from a picture as a number: edges that aren't digits go, any letter left makes it none."""
    inner = F.regexp_replace(c, rf"^((?!{_ANY_DIGIT}).)+|((?!{_ANY_DIGIT}).)+$", "")
    return F.when(inner.rlike(r"\p{L}"), F.lit(None)).otherwise(parse_number(inner))


def plausible(c: Column, glyphs: Column) -> Column:
    """FI12: parses to more than 0, two digits at least, and at most one glyph more than characters."""
    return F.coalesce((parse_number(c)["value"] > 0) & (F.length(digits_of(c)) >= 2) & (F.length(F.regexp_replace(c, r"\s", "")) >= glyphs - 1), F.lit(False))


def apply_rule(op: Column, operand: Column, value: Column) -> Column:
    """MA3: percent, add, set or multiply, exactly."""
    v, r = value.cast("decimal(20,4)"), operand.cast("decimal(12,4)")
    percent = (v * (F.lit(100).cast("decimal(12,4)") + r)).cast("decimal(38,8)") * F.lit("0.01").cast("decimal(3,2)")
    return F.when(op == "percent", percent.cast(MONEY)).when(op == "add", (v + r).cast(MONEY)).when(op == "set", r.cast(MONEY)).when(op == "multiply", (v * r).cast(MONEY))


def round_step(value: Column, step: Column, mode: Column) -> Column:
    """MA4: to a multiple of step (0: as it is): nearest (half up), up or down. Works on whole ten-thousandths, so that
    no division is rounded."""
    v = (value * 10_000).cast("decimal(28,0)")
    s = (step * 10_000).cast("decimal(18,0)")
    low = F.floor(v / s)
    # decimal division may round; set the quotient right
    low = low - F.when(low * s > v, 1).otherwise(0) + F.when((low + 1) * s <= v, 1).otherwise(0)
    left = v - low * s
    up = F.when(mode == "up", left > 0).when(mode == "down", F.lit(False)).otherwise(2 * left >= s)
    out = ((low + F.when(up, 1).otherwise(0)) * s).cast("decimal(28,0)") * F.lit("0.0001").cast("decimal(5,4)")
    return F.when(step > 0, out.cast(MONEY)).otherwise(value.cast(MONEY))


def auto_step(value: Column, decimals: Column) -> Column:
    """MA4: the precision the price is written with: 10^zeros (three at most), or its decimals."""
    whole = F.abs(value).cast("decimal(38,0)").cast("string")
    zeros = F.least(F.length(whole) - F.length(F.rtrim(whole, F.lit("0"))), F.lit(3))
    fraction = (decimals > 0) | (value != value.cast("decimal(38,0)"))
    powers = F.array(*(F.lit(x).cast("decimal(18,4)") for x in ("1", "0.1", "0.01", "0.001", "0.0001")))
    tens = F.array(*(F.lit(x).cast("decimal(18,4)") for x in (1, 10, 100, 1000)))
    return F.when(fraction, F.element_at(powers, F.least(decimals, F.lit(4)) + 1)).when(value == 0, F.lit(1).cast("decimal(18,4)")).otherwise(F.element_at(tens, zeros + 1))


def pct_change(old: Column, new: Column) -> Column:
    """MA9: relative change, 0 where old is 0."""
    return F.coalesce(F.try_divide(new.cast("double") - old.cast("double"), old.cast("double")), F.lit(0.0))


def magnitude(value: Column) -> Column:
    """MA5: floor(log10 |v|), 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value.cast("double"))))).cast("int")


def digit_bucket(n: Column) -> Column:
    """MA5: numbers of digits in four classes."""
    return F.when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 9, "7-9").otherwise("10+")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def format_views(n: Column) -> Column:
    """MA7: 999, 1K, 1.2K, 24.6K, 1M: one decimal, cut, never rounded; from a thousand million the plain number."""
    n = n.cast("long")

    def short(unit: int, letter: str) -> Column:
        tenths = F.floor(n * 10 / unit) if unit == 1 else F.expr("0") + (n * 10 - F.pmod(n * 10, F.lit(unit))) / unit
        tenths = tenths.cast("long")
        whole, part = ((tenths - tenths % 10) / 10).cast("long"), tenths % 10
        return F.concat(whole.cast("string"), F.when(part > 0, F.concat(F.lit("."), part.cast("string"))).otherwise(""), F.lit(letter))

    return F.when(n < 0, F.lit(None)).when(n < 1000, n.cast("string")).when(n < 1_000_000, short(1000, "K")).when(n < 1_000_000_000, short(1_000_000, "M")).otherwise(n.cast("string"))


def parse_views(c: Column, plain_thousands: bool = True) -> Column:
    """MA8: what was typed, as a view count is shown; null where it isn't one number."""
    t = F.translate(latin_digits(F.trim(c)), "٫٬,، ", ".")
    t = F.replace(F.replace(F.upper(t), F.lit("هزار"), F.lit("K")), F.lit("میلیون"), F.lit("M"))
    num, unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KM]?)$", 1), F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KM]?)$", 2)
    value = F.expr("null").cast(MONEY)
    value = F.when(num != "", num.try_cast("decimal(20,4)"))
    plain = F.lit(1000) if plain_thousands else F.lit(1)
    times = F.when(unit == "K", 1000).when(unit == "M", 1_000_000).when(value < 1000, plain).otherwise(1)
    return format_views(F.floor(value * times))


def cell_number(text: Column, most: int = 6) -> Column:
    """PR8: 1 to `most` digits of any script as a number, else null, as is what an int can't hold."""
    return F.when(F.trim(text).rlike(f"^{_ANY_DIGIT}{{1,{most}}}$"), latin_digits(F.trim(text)).try_cast("int"))
