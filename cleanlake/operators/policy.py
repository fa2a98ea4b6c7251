"""The security policy: rules with a severity and an optional replacement, limits, host lists, and their TOML forms."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("ignore", "trace", "info", "warn", "error")
#: Fixed set of characters that no attribute value may bring in.
ATTRIBUTE_BREAKERS = " \n\r\t\x0c/>="


def clean_attribute(value: str) -> str:
    return value.translate({ord(c): None for c in ATTRIBUTE_BREAKERS})


@dataclass(frozen=True)
class ReplaceRule:
    """What a violation is logged as, and what takes its place; None keeps the original. An error ends the document."""

    level: str = "warn"
    replace: str | None = None

    @classmethod
    def parse(cls, value: Any, default: str) -> ReplaceRule:
        """A level, a boolean, a replacement, or a table with `replace` and `level`."""
        if isinstance(value, bool):
            return cls("warn", default if value else None)
        if isinstance(value, str):
            if value in LEVELS:
                return cls(value, None if value == "error" else default)
            return cls("warn", value)
        if isinstance(value, dict) and set(value) <= {"replace", "level"}:
            level, new = value.get("level", "warn"), value.get("replace")
            if level not in LEVELS:
                raise ValueError(f"no such level: {level}")
            if isinstance(new, bool):
                new = default if new else None
            return cls(level, new)
        raise ValueError(f"not a rule: {value!r}")


@dataclass(frozen=True)
class LimitRule:
    """The most that is allowed, and what going beyond it is logged as. An error ends what went beyond."""

    value: int
    level: str = "error"

    def exceeded(self, value: Column | str) -> Column:
        """Whether value goes beyond the limit; null counts as nothing."""
        return F.coalesce((F.col(value) if isinstance(value, str) else value) > self.value, F.lit(False))

    def ends(self, value: Column | str) -> Column:
        """Whether value goes beyond a limit that ends what does."""
        return self.exceeded(value) if self.level == "error" else F.lit(False)

    @classmethod
    def parse(cls, value: Any, default: int) -> LimitRule:
        """A value, a level, a pair of both, or a table with `value` and `level`."""
        if isinstance(value, bool):
            raise ValueError(f"not a limit: {value!r}")
        if isinstance(value, int):
            return cls(value)
        if isinstance(value, str) and value in LEVELS:
            return cls(default, value)
        if isinstance(value, list) and len(value) == 2:
            return cls(int(value[0]), value[1])
        if isinstance(value, dict) and set(value) <= {"value", "level"}:
            return cls(int(value.get("value", default)), value.get("level", "error"))
        raise ValueError(f"not a limit: {value!r}")


#: Fixed default replacements of the rules.
REPLACEMENTS = {
    "event_handlers": "", "xml_entities": "<!-- Blocked entity -->", "meta_refresh": "", "dangerous_scripts": "#", "dangerous_origins": "#",
    "dangerous_domains": "#", "dangerous_uris": "#", "idn": "#", "dangerous_js": "/* Blocked script */",
}


@dataclass(frozen=True)
class Policy:
    """Defaults are those of the published default policy."""

    allow_scripts: tuple[str, ...] = ()
    allow_origins: tuple[str, ...] = ("trusted.com",)
    event_handlers: ReplaceRule = ReplaceRule("info", "")
    xml_entities: ReplaceRule = ReplaceRule("error")
    meta_refresh: ReplaceRule = ReplaceRule("warn", "")
    dangerous_scripts: ReplaceRule = ReplaceRule("error")
    dangerous_origins: ReplaceRule = ReplaceRule("error")
    dangerous_domains: ReplaceRule = ReplaceRule("error")
    dangerous_uris: ReplaceRule = ReplaceRule("info", "#")
    denied: tuple[str, ...] = ("malicious-domain.com", "evil.com")
    idn: ReplaceRule = ReplaceRule("warn", "#")
    idn_connection: str = "warn"
    fetch_sub_resources: bool = True
    max_subresources: LimitRule = LimitRule(5)
    max_resource_depth: LimitRule = LimitRule(1)
    max_bytes: LimitRule = LimitRule(1 << 20)
    mismatched_mime: str = "error"
    unknown_resource: str = "error"
    pdf_active_content: str = "error"
    dangerous_js: ReplaceRule = ReplaceRule("error")
    connection_timeout: float = 3.0
    overall_timeout: float = 15.0
    max_redirects: LimitRule = LimitRule(2)
    user_agent: str = "cleanlake/0.1.0"
    dangerous_connection: str = "error"
    #: The published engine's own way where it differs from the safe one: see README.
    compat: bool = field(default=False)

    def with_(self, **changes: Any) -> Policy:
        return replace(self, **changes)


#: TOML sections and the keys in them that are called otherwise here.
SECTIONS = {
    "html": ("allow_scripts", "allow_origins", "event_handlers", "xml_entities", "meta_refresh", "dangerous_scripts", "dangerous_origins", "dangerous_domains", "dangerous_uris"),
    "urls": ("dangerous_domains", "idn", "idn_connection"),
    "resources": ("fetch_sub_resources", "max_subresources", "max_resource_depth", "max_bytes", "mismatched_mime", "unknown_resource", "pdf_active_content", "dangerous_js"),
    "connections": ("connection_timeout", "overall_timeout", "max_redirects", "user_agent", "dangerous_connection"),
}
_UNITS = {"ms": 0.001, "s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "d": 86400}


def seconds(text: str) -> float:
    """A duration such as `1m 30s`."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text)
    if not parts or any(u not in _UNITS for _, u in parts):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def host_of(text: str) -> str:
    """A valid policy host, lower-cased."""
    if not text or re.search(r"[\s/?#@<>\\^|%:]", text) and not re.fullmatch(r"\[[0-9a-fA-F:.]+\]", text):
        raise ValueError(f"not a host: {text!r}")
    return text.lower() if text.isascii() else text.lower().encode("idna").decode()


def load_policy(text: str | None = None) -> Policy:
    """The policy of a TOML text; missing keys and sections keep their defaults, unknown ones are passed over."""
    policy, changes = Policy(), {}
    kinds = {f.name: f.type for f in fields(Policy)}
    for section, values in (tomllib.loads(text) if text else {}).items():
        for key in SECTIONS.get(section, ()):
            if key not in values:
                continue
            name, value = ("denied" if (section, key) == ("urls", "dangerous_domains") else key), values[key]
            kind = kinds[name]
            if kind == "ReplaceRule":
                rule = ReplaceRule.parse(value, REPLACEMENTS[name])
                plain = name not in ("dangerous_uris", "xml_entities", "dangerous_js") and rule.replace is not None
                changes[name] = replace(rule, replace=clean_attribute(rule.replace)) if plain else rule
            elif kind == "LimitRule":
                changes[name] = LimitRule.parse(value, getattr(policy, name).value)
            elif kind.startswith("tuple"):
                changes[name] = tuple(host_of(v) for v in value)
            elif kind == "float":
                changes[name] = seconds(value)
            else:
                changes[name] = value
    return replace(policy, **changes)


def dump_default() -> str:
    """The default policy as TOML."""
    policy, out = Policy(), []

    def written(value: Any) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, ReplaceRule):
            return f'"{value.level}"' if value.replace is None else f'{{ replace = "{value.replace}", level = "{value.level}" }}'
        if isinstance(value, LimitRule):
            return f'{{ value = {value.value}, level = "{value.level}" }}'
        if isinstance(value, tuple):
            return "[" + ", ".join(f'"{v}"' for v in value) + "]"
        return f'"{value:g}s"' if isinstance(value, float) else f'"{value}"'

    for section, keys in SECTIONS.items():
        out.append(f"[{section}]")
        out += [f"{k} = {written(getattr(policy, 'denied' if (section, k) == ('urls', 'dangerous_domains') else k))}" for k in keys]
    return "\n".join(out) + "\n"
