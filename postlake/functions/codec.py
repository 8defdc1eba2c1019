"""Search filters as a query string and back: unknown fields, bad values and repeats are dropped, defaults are left out."""

from __future__ import annotations

import re
from dataclasses import fields
from urllib.parse import parse_qsl, urlencode

from postlake.operators.search import AREAS, Filters

DATE = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")
ALLOWED = {"areas": set(AREAS), "programs": {"internship", "coop", "regular"}, "seasons": {"spring", "summer", "fall", "winter"}, "arrangement": {"remote", "hybrid", "onsite", "unknown"}, "topic": {"ai-data"}}
DEFAULTS = {f.name: f.default for f in fields(Filters)}


def _values(name: str, raw: list[str]) -> tuple:
    """Trimmed, allowed, and each once without regard to case."""
    seen: dict = {}
    for v in (x.strip() for r in raw for x in (r.split(",") if name in ("areas", "programs", "seasons", "years") else [r])):
        if name == "years":
            if re.fullmatch(r"20\d\d|2100", v):
                seen.setdefault(v, int(v))
        elif v and v.lower() in ALLOWED.get(name, {v.lower()}):
            seen.setdefault(v.lower(), v.lower() if name in ALLOWED else v)
    return tuple(seen.values())


def parse(text: str) -> Filters:
    given: dict[str, list[str]] = {}
    for name, value in parse_qsl(text.lstrip("?")):
        if name in DEFAULTS:
            given.setdefault(name, []).append(value)
    out = {}
    for name, raw in given.items():
        default, last = DEFAULTS[name], raw[-1].strip()
        if isinstance(default, tuple):
            out[name] = _values(name, raw)
        elif name in ("limit", "offset"):
            if re.fullmatch(r"\d{1,9}", last) and (name == "offset" or 1 <= int(last) <= 100):
                out[name] = int(last)
        elif name in ("salary_from", "salary_to"):
            if re.fullmatch(r"\d{1,12}(\.\d+)?", last):
                out[name] = float(last)
        elif name in ("published_from", "published_to", "as_of"):
            if DATE.fullmatch(last):
                out[name] = last
        elif last and last.lower() in ALLOWED.get(name, {last.lower()}):
            out[name] = last
    return Filters(**out)


def serialize(filters: Filters) -> str:
    """Fields in their fixed order, defaults left out; parse() gives the same filters back."""
    pairs = []
    for name, default in DEFAULTS.items():
        value = getattr(filters, name)
        if value != default:
            pairs += [(name, v) for v in value] if isinstance(value, tuple) else [(name, value)]
    return urlencode(pairs)


def active_filters(filters: Filters) -> int:
    """How many fields filter something; the page and the clock do not count."""
    return sum(getattr(filters, n) != d for n, d in DEFAULTS.items() if n not in ("limit", "offset", "as_of"))
