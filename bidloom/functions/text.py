"""Text functions: Unicode-aware trimming, names, tax numbers, urls, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, plain_text

#: Unicode white space; Java's \s needs (?U) for it.
ENDS = r"(?U)^\s+|\s+$"
RUNS = r"(?U)\s+"


def strip(c: Column | str) -> Column:
    """Trims all Unicode white space; null becomes ''."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), ENDS, ""), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """strip() with inner white space as single spaces."""
    return F.regexp_replace(strip(c), RUNS, " ")


def normalize_name(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def normalize_name_sql(c: Column | str) -> Column:
    """The variant that trims plain spaces after the collapse; null stays null."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\D", "")


def first_code(codes: Column | str, code: Column | str | None = None) -> Column:
    """The first of a comma-separated list, else ``code``; '' if there is none."""
    value = F.nullif(col(codes), F.lit(""))
    if code is not None:
        value = F.coalesce(value, F.nullif(col(code), F.lit("")))
    return strip(F.split_part(F.coalesce(value, F.lit("")), F.lit(","), F.lit(1)))


def first_group(c: Column | str, pattern: str) -> Column:
    """Group 1 of the first match; null without a match."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def inn_from_link(c: Column | str) -> Column:
    return first_group(c, r"inn=(\d{10,12})")


def inn_from_text(c: Column | str) -> Column:
    """A tax number at most 20 non-digits after its label."""
    return first_group(c, r"(?iu)инн[^0-9]{0,20}(\d{10,12})")


def resolve_inn(link: Column | str, link_pattern: str | None, page_text: Column | str | None) -> Column:
    """From the link if a pattern is configured and matches, else from the organisation page if there is one."""
    sources = [first_group(link, link_pattern)] if link_pattern else []
    if page_text is not None:
        sources.append(inn_from_text(page_text))
    return F.coalesce(*sources, F.lit(None).cast("string"))


def absolute_url(href: Column | str, base: Column | str, only_rooted: bool = False) -> Column:
    """http links stay; others get the base without its last slashes (only rooted ones, if so asked)."""
    href = col(href)
    joined = F.concat(F.regexp_replace(col(base), "/+$", ""), href)
    if only_rooted:
        return F.when(F.startswith(href, F.lit("/")), joined).otherwise(href)
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(joined)


def files_page_url(url: Column | str, page: str) -> Column:
    """The url with its last path segment replaced; the query stays."""
    return F.regexp_replace(col(url), r"^([^?]*/)[^/?]*", F.concat(F.lit("$1"), F.lit(page)))


def percent_encode(c: Column | str) -> Column:
    """Everything but letters, digits and _.-~ as %XX of UTF-8."""
    out = F.url_encode(col(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _shown(kind: Column, text: Column) -> Column:
    """The text of a value of a type: doubles by their fewest digits, times in ISO form with six digits of a second's
    parts or none and the offset where they have a zone, flags as True and False; blank text is null."""
    whole = F.translate(F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text), " ", "T")
    time = F.when(kind == "timestamp", F.concat(whole, F.date_format(F.try_to_timestamp(text), "xxx"))).otherwise(whole)
    shown = F.when(kind.isin("double", "float"), plain_text(text)).when(F.startswith(kind, F.lit("timestamp")), time).when(kind == "boolean", F.initcap(text)).otherwise(text)
    return F.element_at(F.transform(F.array(strip(shown)), lambda t: F.when(t != "", t)), 1)


def as_texts(*columns: Column | str) -> Column:
    """An array of the columns' values as text, null for blank ones; one expression serves all of them."""
    values = [F.struct(F.typeof(col(c)).alias("kind"), col(c).cast("string").alias("text")) for c in columns]
    return F.transform(F.array(*values), lambda v: _shown(v["kind"], v["text"]))


def as_text(c: Column | str) -> Column:
    return F.element_at(as_texts(c), 1)


def json_texts(json: Column | str, *fields: str) -> Column:
    """An array of a JSON object's fields as as_texts() has them; a number with a point, or beyond 64 bits, is a double."""

    def own(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        double = (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
        text = F.when(double, F.try_variant_get(v, "$", "double").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))
        return F.struct(F.when(double, "double").when(kind == "BOOLEAN", "boolean").otherwise("string").alias("kind"), text.alias("text"))

    parsed = F.transform(F.array(F.try_parse_json(col(json))), lambda v: F.array(*[F.try_variant_get(v, f"$.{f}", "variant") for f in fields]))
    return F.transform(F.transform(F.element_at(parsed, 1), own), lambda v: _shown(v["kind"], v["text"]))


def safe_file_url(c: Column | str) -> Column:
    """http(s) urls and relative ones without a host; null for others."""
    c = col(c)
    ok = c.rlike(r"(?i)^https?://[^/?#]+") | (~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.startswith(c, F.lit("//")) & (c != ""))
    return F.when(ok, c)


def mask_dsn(c: Column | str) -> Column:
    """Hides the password of a connection string."""
    return F.regexp_replace(col(c), r"(://[^:/@]+:)[^@]*@", "$1***@")


def jdbc_triple(c: Column | str) -> Column:
    """struct<url, user, password> of a connection string."""
    c = col(c)
    pattern = r"^[a-z+0-9]+://(?:([^:/@]+)(?::([^@]*))?@)?(.*)$"
    return F.struct(F.concat(F.lit("jdbc:postgresql://"), F.regexp_extract(c, pattern, 3)).alias("url"), F.regexp_extract(c, pattern, 1).alias("user"), F.regexp_extract(c, pattern, 2).alias("password"))


def bem_classes(selector: Column | str) -> Column:
    """Different class names of a selector that contain __, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(col(selector), F.lit(r"\.([A-Za-z0-9_-]+)"), F.lit(1)), lambda x: F.contains(x, F.lit("__"))))


def first_class(selector: Column | str, default: str) -> Column:
    return F.coalesce(first_group(selector, r"\.([A-Za-z0-9_-]+)"), F.lit(default))


def json_time(json: Column | str, field: str) -> Column:
    """A JSON field as a time with a zone; null where it is missing or no time."""
    return F.try_to_timestamp(F.get_json_object(col(json), f"$.{field}"))
