"""Named handlers of raw values: a registry of name -> (column, argument) -> column.

Handlers return null for input that they can't read; ``strip`` and ``lower`` return '' for null. Unknown and empty
names are the identity. Timestamps are UTC; the portals' local time is three hours ahead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col
from .text import first_group, strip

PORTAL_ZONE = "+03:00"

# The patterns of cards' raw texts, and the readable date formats in the order in which they are tried.
NOT_MONEY = r"[^\d.,\-]"
PUBLISHED = r"(?U)с\s+(\d{2}\.\d{2}\.\d{4})"
DEADLINE = r"(?U)до\s+(\d{2}\.\d{2}\.\d{4})\s+(\d{1,2}:\d{2})"
LAW = r"44-ФЗ|223-ФЗ"
AMOUNT = r"(?U)\d[\d\s]*,\d{2}"
NUMBER = r"(?U)\d[\d\s]*"
DATE_FORMATS = ("d.M.yyyy", "d.M.yyyy H:m", "d.M.yyyy H:m:s", "yyyy-M-d", "yyyy-M-d'T'H:m:s")


def money(c: Column | str) -> Column:
    cleaned = F.replace(F.regexp_replace(col(c).cast("string"), NOT_MONEY, ""), F.lit(","), F.lit("."))
    return F.when(cleaned.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), cleaned.try_cast("double"))


def number(c: Column | str) -> Column:
    text = strip(col(c))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | text.rlike(r"(?i)^[+-]?(inf|infinity|nan)$")
    return F.when(plain, text.try_cast("double"))


def integer(c: Column | str) -> Column:
    cleaned = F.regexp_replace(col(c).cast("string"), NOT_MONEY, "")
    return F.when(cleaned.rlike(r"^-?\d+$"), cleaned.try_cast("bigint"))


def date_iso(c: Column | str) -> Column:
    text = strip(col(c))
    when = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")


def _portal(text: Column, pattern: str) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), PORTAL_ZONE)


def date(c: Column | str) -> Column:
    return _portal(strip(col(c)), "d.M.yyyy")


def pub_date(c: Column | str) -> Column:
    return _portal(first_group(c, PUBLISHED), "d.M.yyyy")


def deadline(c: Column | str) -> Column:
    c = col(c)
    return _portal(F.when(c.rlike(DEADLINE), F.concat_ws(" ", F.regexp_extract(c, DEADLINE, 1), F.regexp_extract(c, DEADLINE, 2))), "d.M.yyyy H:m")


def law(c: Column | str) -> Column:
    return F.regexp_substr(col(c), F.lit(LAW))


def security(c: Column | str) -> Column:
    c = col(c)
    return money(F.coalesce(F.regexp_substr(c, F.lit(AMOUNT)), F.regexp_substr(c, F.lit(NUMBER))))


def security_unit(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.rlike(AMOUNT), "руб.").when(F.contains(c, F.lit("%")), "%")


def regex(c: Column | str, pattern: str | None) -> Column:
    return first_group(c, pattern) if pattern else F.lit(None).cast("string")


def date_range_text(published: Column | str, until: Column | str) -> Column:
    """The cards' text for a publication day and a deadline; pub_date() and deadline() read it back."""
    return F.concat(F.lit("с "), F.date_format(col(published), "dd.MM.yyyy"), F.lit(" до "), F.date_format(col(until), "dd.MM.yyyy HH:mm"), F.lit(" (МСК)"))


HANDLERS: dict[str, Callable[..., Column]] = {
    "none": col,
    "strip": strip,
    "lower": lambda c: F.lower(strip(c)),
    "money": money,
    "float": number,
    "int": integer,
    "date_iso": date_iso,
    "date": date,
    "pub_date": pub_date,
    "deadline": deadline,
    "law": law,
    "regex": regex,
    "security": security,
    "security_unit": security_unit,
}


def apply_handler(name: str | None, c: Column | str, arg: str | None = None) -> Column:
    handler = HANDLERS.get(name or "none", col)
    return handler(c, arg) if name == "regex" else handler(c)
