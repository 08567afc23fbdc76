"""Rounding, money and small number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half(c: Column | str, digits: int = 2) -> Column:
    """Rounds the exact binary value of a double, as printf does; null stays null."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", col(c), F.lit(pattern)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0.0 where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high)))


def money_text(c: Column | str) -> Column:
    """1 234 567,89 ₽ with no-break spaces between the groups."""
    return F.concat(F.translate(F.format_number(col(c), 2), ",.", NBSP + ","), F.lit(" ₽"))


def plural(n: Column | str, one: str, few: str, many: str) -> Column:
    """The Russian word form that goes with a count."""
    n = col(n)
    tens, units = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tens.between(10, 20), many).when(units == 1, one).when(units.between(2, 4), few).otherwise(many)


def yes_no(flag: Column | str) -> Column:
    return F.when(col(flag), "да").otherwise("нет")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_digits(digits: Column, exponent: Column) -> Column:
    return F.struct(digits.alias("digits"), exponent.alias("exponent"))


def _shorter(size: Column, found: Column) -> Column:
    """The nearer number of one digit less, if that is still the double ``size``."""
    low = F.call_function("div", found["digits"], F.lit(10))
    is_it = lambda digits: F.concat_ws("E", digits.cast("string"), (found["exponent"] + 1).cast("string")).cast("double") == size
    down, up = _with_digits(low, found["exponent"] + 1), _with_digits(low + 1, found["exponent"] + 1)
    nearer_down = found["digits"] % 10 + low % 2 <= 5  # of two equally near ones the even one
    return F.when(nearer_down & is_it(low), down).when(is_it(low + 1), up).when(is_it(low), down).otherwise(found)


def _nearest(size: Column, found: Column) -> Column:
    """Of numbers of so many digits the nearest one, by the whole number that a double from 2 ** 53 to 10 ** 37 is.

    The cast's digits may be off by one there, and of several that mean the same double the nearest counts.
    """
    large = (size >= float(2**53)) & (size < 1e37)
    bits = F.when(large, F.floor(F.log2(size)) - 53).otherwise(0).cast("int")  # at most 69: two factors that a double holds
    half = F.floor(bits / 2).cast("int")
    power = lambda n: F.pow(F.lit(2.0), n).cast("bigint").cast("decimal(19,0)")
    exact = F.when(large, size / F.pow(F.lit(2.0), bits)).otherwise(0.0).cast("bigint").cast("decimal(19,0)") * (power(half) * power(bits - half)).cast("decimal(22,0)")
    unit = F.rpad(F.lit("1"), F.when(large, F.greatest(found["exponent"], F.lit(0))).otherwise(0) + 1, "0").cast("decimal(38,0)")

    def rounded(x: Column) -> Column:
        low = F.call_function("div", x["exact"], x["unit"])
        rest = (x["exact"] - low.cast("decimal(19,0)") * x["unit"]) * F.lit(2).cast("decimal(1,0)")
        up = (rest > x["unit"]) | ((rest == x["unit"]) & (low % 2 == 1))
        return _with_digits(low + up.cast("bigint"), found["exponent"])

    return F.when(large & (found["exponent"] > 0), _let(F.struct(exact.cast("decimal(38,0)").alias("exact"), unit.alias("unit")), rounded)).otherwise(found)


def _spread(found: Column) -> Column:
    """digits * 10 ** exponent: plain from 0.0001 up to below 10 ** 16, else with an exponent."""
    text = F.rtrim(found["digits"].cast("string"), F.lit("0"))
    power = F.length(found["digits"].cast("string")) - 1 + found["exponent"]

    def spread(x: Column) -> Column:
        t, p = x["text"], x["power"]
        n = F.length(t)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), t)
        whole = F.concat(t, F.repeat(F.lit("0"), p + 1 - n), F.lit(".0"))
        mixed = F.concat(F.left(t, p + 1), F.lit("."), F.substring(t, p + 2, n))
        size = F.abs(p).cast("string")
        far = F.concat(F.left(t, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(t, 2, n))).otherwise(""), F.when(p < 0, "e-").otherwise("e+"), F.when(F.length(size) < 2, "0").otherwise(""), size)
        return F.when((p < -4) | (p >= 16), far).when(p < 0, small).when(n <= p + 1, whole).otherwise(mixed)

    return _let(F.struct(text.alias("text"), power.alias("power")), spread)


def _by_digits(x: Column) -> Column:
    size, text = F.abs(x), x.cast("string")
    whole, fraction = F.regexp_extract(text, r"(\d+)\.(\d+)", 1), F.regexp_extract(text, r"(\d+)\.(\d+)", 2)
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0)) - F.length(fraction)
    found = _with_digits(F.concat(whole, fraction).cast("bigint"), exponent)
    for _ in range(2):
        found = _let(found, lambda f: _shorter(size, f))
    found = _let(found, lambda f: _nearest(size, f))
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    known = F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, F.concat(sign, F.lit("0.0")))
    return known.when(x.isNotNull(), F.concat(sign, _let(found, _spread)))


def plain_text(c: Column | str) -> Column:
    """A double by its fewest digits, without an exponent from 0.0001 up to below 10 ** 16: 25000000.0, 0.0001, 1e+16.

    Up to 15 digits tell all doubles apart, so a text that has no more is the shortest: the cast's own, a whole number's, or
    one of cents. Others, and those with an exponent, are spread out digit by digit: the cast may give a digit more than
    needed, and an exponent from 10 ** 7, so its digits are shortened as long as they still mean the same double.
    """
    x = col(c).cast("double")
    size, text = F.abs(x), x.cast("string")
    cents = F.when(size < 1e13, x).cast("decimal(17,2)")
    short = F.when((size >= 1e-3) & (size < 1e7) & (F.length(text) <= 16), text)
    short = short.when((size < 1e15) & (x == F.floor(F.when(size < 1e15, x))) & (x != 0), F.concat(F.when(size < 1e15, x).cast("bigint").cast("string"), F.lit(".0")))
    short = short.when((size >= 1) & (size < 1e13) & (cents.cast("double") == x), F.rtrim(cents.cast("string"), F.lit("0")))
    return short.otherwise(_by_digits(x))


def query_text(c: Column | str, kind: str) -> Column:
    """A criterion as query text: lists are joined by commas, whole doubles lose their fraction."""
    c = col(c)
    if kind == "list":
        return F.array_join(c, ",")
    if kind == "double":
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(plain_text(c))
    return c.cast("string")


def retry_delay(attempt: Column | str, least: float, most: float, jitter: Column | None = None) -> Column:
    """Doubling delay from ``least`` up to ``most``, and a jitter on top."""
    delay = F.least(F.lit(float(most)), F.lit(float(least)) * F.pow(F.lit(2.0), col(attempt) - 1))
    return delay if jitter is None else delay + jitter


def linear_delay(attempt: Column | str, step: float) -> Column:
    return F.lit(float(step)) * col(attempt)


def shown_number(c: Column | str, digits: int = 3) -> Column:
    """A number as Russian pages show it: groups of three parted by a no-break space, a comma, no closing zeros."""
    text = F.translate(F.format_number(col(c), digits), ",.", "\u00a0,")
    return F.regexp_replace(text, r",?0+$", "") if digits else text


def shown_time(c: Column | str, seconds: bool = True) -> Column:
    return F.date_format(col(c), "dd.MM.yyyy, HH:mm:ss" if seconds else "dd.MM.yyyy, HH:mm")
