"""Settings that plans are built from; nothing here is read per row."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

# Coefficients by classification code, and the methods' names.
FIT_TABLE = {"62.01": 0.9, "62.02": 0.8, "62.09": 0.7, "63.11": 0.6}
METHOD_DEFAULT, METHOD_EXPIRED = "default", "deadline_expired"
CATEGORIES = ("perfect", "synonym", "close", "far", "false_friend")
POSITIVE_CATEGORIES = ("perfect", "synonym", "close")


@dataclass(frozen=True)
class ScoreConfig:
    fit_table: dict[str, float] = field(default_factory=lambda: dict(FIT_TABLE))
    default_fit: float = 0.5
    p_win: float = 1.0
    margin_rate: float = 1.0
    max_fit: float = 10.0
    normalize_fit: bool = True
    digits: int = 2
    refine_rounds: int = 1


@dataclass(frozen=True)
class StopConditions:
    deadline_not_expired: bool = True
    min_deadline_days: float | None = None
    enabled: bool = True


@dataclass(frozen=True)
class SearchCriteria:
    okpd_codes: tuple[str, ...] = ()
    fz44: bool = False
    fz223: bool = False
    nmck_min: float | None = None
    nmck_max: float | None = None


@dataclass(frozen=True)
class Variable:
    """One extracted variable: which match of a selector, its text or an attribute, and a handler."""

    name: str
    selector: str
    attribute: str | None = None
    index: int | None = None
    handler: str | None = None
    handler_arg: str | None = None
    default: Any = None


@dataclass(frozen=True)
class Platform:
    id: str
    url: str
    list_path: str = "/"
    container: str = "body"
    list_variables: tuple[Variable, ...] = ()
    detail_variables: tuple[Variable, ...] = ()


def require_platforms(platforms: list[Platform]) -> list[Platform]:
    if not platforms:
        raise ValueError("at least one platform is needed")
    return platforms


def enabled_sites(sites: dict[str, bool], platforms: list[Platform]) -> tuple[list[Platform], list[str]]:
    """The platforms of enabled sites, and the enabled sites that have none."""
    known = {p.id: p for p in platforms}
    on = [s for s, flag in sites.items() if flag]
    return [known[s] for s in on if s in known], [s for s in on if s not in known]


def layered(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """Settings of which the first layer that has a key decides (arguments, environment, file, defaults)."""
    out: dict[str, Any] = {}
    for layer in reversed(layers):
        out |= {k: v for k, v in (layer or {}).items() if v is not None}
    return out


def redacted(settings: dict[str, Any], secrets: tuple[str, ...] = ("dsn", "token", "password", "secret", "api_key")) -> dict[str, Any]:
    """Settings without their secret keys, at any depth."""
    return {k: redacted(v, secrets) if isinstance(v, dict) else v for k, v in settings.items() if not any(s in k.lower() for s in secrets)}


def from_settings(kind: type, data: dict[str, Any], path: str = "") -> Any:
    """A settings object of nested dictionaries and lists; a key that its class doesn't have is an error, at any depth."""
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    if unknown := [f"{path}{k}" for k in data if k not in known]:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")

    def value(hint: Any, given: Any, at: str) -> Any:
        inner = [a for a in get_args(hint) if is_dataclass(a)]
        if is_dataclass(hint) and isinstance(given, dict):
            return from_settings(hint, given, f"{at}.")
        if get_origin(hint) is tuple and isinstance(given, list | tuple):
            return tuple(value(inner[0], v, f"{at}[{k}]") if inner else v for k, v in enumerate(given))
        if get_origin(hint) is dict and inner and isinstance(given, dict):
            return {k: value(inner[0], v, f"{at}.{k}") for k, v in given.items()}
        return from_settings(inner[0], given, f"{at}.") if inner and isinstance(given, dict) else given

    return kind(**{k: value(hints[k], v, f"{path}{k}") for k, v in data.items()})
