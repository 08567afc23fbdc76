"""List pages' urls with the search criteria pushed down into the query string, as column expressions."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.handlers import PORTAL_ZONE
from ..functions.numbers import plain_text
from ..functions.text import percent_encode


@dataclass(frozen=True)
class Mapping:
    """Where a criterion goes: a dotted path of the filter, a parameter of its own, or both; or several parameters, whose
    templates name the codes' ids and the codes: {okpd2_ids}, {okpd2_codes}."""

    json_path: str | None = None
    query_param: str | None = None
    query_params: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Search:
    query_params: dict[str, str] = field(default_factory=dict)
    filter_json: dict[str, Any] = field(default_factory=dict)
    state_json: dict[str, Any] = field(default_factory=dict)
    criteria_map: dict[str, Mapping] = field(default_factory=dict)
    date_format: str = "dd.MM.yyyy HH:mm:ss"
    enabled: bool = True


@dataclass(frozen=True)
class Criteria:
    """Criteria as columns; a null column, or none, is a criterion that isn't given."""

    cutoff: Column | None = None
    now: Column | None = None
    okpd_paths: Column | None = None
    #: Joined by commas, as codes.resolve_code_ids() gives them; null where no code has an id.
    okpd_ids: Column | None = None
    okpd_codes: Column | None = None
    fz44: Column | None = None
    fz223: Column | None = None
    nmck_min: Column | None = None
    nmck_max: Column | None = None


def local_date(c: Column | None, pattern: str) -> Column | None:
    """A UTC time in the source's zone by a pattern."""
    return None if c is None else F.date_format(F.from_utc_timestamp(c, PORTAL_ZONE), pattern)


def toggle(c: Column | None) -> Column | None:
    """on, or nothing."""
    return None if c is None else F.when(c, "on")


#: How each criterion is made of the criteria and the search's settings; more can be given to query_string().
TERMS: dict[str, Callable[[Criteria, Search], Column | None]] = {
    "publish_date": lambda c, s: local_date(c.cutoff, s.date_format),
    "update_date": lambda c, s: local_date(c.cutoff, s.date_format),
    "deadline_from": lambda c, s: local_date(c.now, s.date_format),
    "okpd2": lambda c, s: None if c.okpd_paths is None else F.when(F.size(c.okpd_paths) > 0, c.okpd_paths),
    "fz44": lambda c, s: toggle(c.fz44),
    "fz223": lambda c, s: toggle(c.fz223),
    "nmck_min": lambda c, s: c.nmck_min,
    "nmck_max": lambda c, s: c.nmck_max,
}
LISTS, NUMBERS = frozenset(("okpd2", "paths")), frozenset(("nmck_min", "nmck_max"))


def put(tree: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy of nested objects with ``value`` at a dotted path, whose objects are made where they are missing."""
    first, _, rest = path.partition(".")
    return tree | {first: put(tree.get(first, {}), rest, value) if rest else value}


def as_json(tree: Any) -> Column:
    """Compact JSON of nested objects whose leaves are constants or columns of JSON text; null columns leave their key out."""
    if isinstance(tree, Column):
        return tree
    if not isinstance(tree, dict):
        return F.lit(json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
    own = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), as_json(v)) for k, v in tree.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*own)), ","), F.lit("}")) if own else F.lit("{}")


def _json_value(key: str, c: Column) -> Column:
    if key in LISTS:
        return F.to_json(c)
    if key in NUMBERS:
        return plain_text(c)
    quoted = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _text_value(key: str, c: Column) -> Column:
    if key in LISTS:
        return F.array_join(c, ",")
    if key not in NUMBERS:
        return c.cast("string")
    whole = (c == F.floor(c)) & (F.abs(c) < float(2**63))
    return F.when(whole, F.when(whole, c).cast("bigint").cast("string")).otherwise(plain_text(c))


def _filled(template: str, criteria: Criteria) -> Column:
    """A parameter's template with the codes' ids and codes; null where it needs some that aren't given."""
    text = F.lit(template)
    for name, value in (("{okpd2_ids}", criteria.okpd_ids), ("{okpd2_codes}", criteria.okpd_codes)):
        if name in template:
            text = F.replace(text, F.lit(name), F.lit(None).cast("string") if value is None else F.nullif(value, F.lit("")))
    return text


def _parameters(given: list[tuple[str, Column]]) -> list[Column]:
    """name=value of each parameter where it is given first; of several values the last stands."""
    out = []
    for k, (name, value) in enumerate(given):
        same = [v for n, v in given if n == name]
        first = value.isNotNull()
        for n, v in given[:k]:
            first = first & v.isNull() if n == name else first
        out.append(F.when(first, F.concat(F.lit(f"{name}="), percent_encode(F.coalesce(*reversed(same))))))
    return out


def query_string(search: Search, criteria: Criteria, terms: dict[str, Callable[[Criteria, Search], Column | None]] | None = None) -> Column:
    """The query string: the search's own parameters with the filter and state filled in, then those of the criteria.
    Criteria that aren't given, and unknown ones, with a warning, are left out."""
    known, tree, extra = TERMS | (terms or {}), search.filter_json, []
    for key, mapping in search.criteria_map.items():
        if mapping.query_params:
            extra += [(name, _filled(template, criteria)) for name, template in mapping.query_params.items()]
            continue
        if key not in known:
            warnings.warn(f"unknown search criterion {key}", stacklevel=2)
            continue
        value = known[key](criteria, search)
        if value is None:
            continue
        if mapping.json_path:
            tree = put(tree, mapping.json_path, _json_value(key, value))
        if mapping.query_param:
            extra.append((mapping.query_param, _text_value(key, value)))
    own = []
    for key, template in search.query_params.items():
        text = F.lit(template)
        for name, value in (("{filter_json}", tree), ("{state_json}", search.state_json)):
            if name in template:
                text = F.replace(text, F.lit(name), as_json(value))
        own.append(F.concat(F.lit(f"{key}="), percent_encode(text)))
    return F.array_join(F.array_compact(F.array(*own, *_parameters(extra))), "&") if own or extra else F.lit("")


def list_url(url: str, list_path: str, search: Search | None, criteria: Criteria, terms: dict | None = None) -> Column:
    """The url of a platform's list page; without a search, or with one that is off, no query string."""
    base = F.lit(url.rstrip("/") + list_path)
    return base if search is None or not search.enabled else F.concat(base, F.lit("?"), query_string(search, criteria, terms))
