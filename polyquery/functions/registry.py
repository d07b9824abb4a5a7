"""Function names of the dialects and the Spark SQL each becomes.

A definition is a template over the argument texts: ``{0}`` is the first
argument, ``{1:x}`` the second or the text ``x`` if it is missing, ``{*}`` all of
them and ``{1*}`` those from the second on. Families may define a name
differently; a dialect sees its own families first, then the shared ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from polyquery.profiles import Profile, profile


class Unsupported(ValueError):
    """A function or clause that the dialect doesn't have, or that Spark can't express."""


Template = str | Callable[[list[str], Profile], str]
_SLOT = re.compile(r"\{(\d*)(\*?)(?::([^{}]*))?\}")


def render(template: Template, args: list[str], rules: Profile) -> str:
    if callable(template):
        return template(args, rules)

    def fill(m: re.Match) -> str:
        at, rest, default = m.group(1), m.group(2), m.group(3)
        if rest:
            return ", ".join(args[int(at or 0) :])
        if int(at) < len(args):
            return args[int(at)]
        if default is not None:
            return default
        raise Unsupported(f"argument {int(at) + 1} is missing")

    return _SLOT.sub(fill, template)


@dataclass
class FunctionCatalog:
    """name -> family -> template; the family "" is shared."""

    known: dict[str, dict[str, Template]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    def add(self, names: str, template: Template, family: str = "", kind: str = "scalar") -> None:
        for name in names.split():
            self.known.setdefault(name, {})[family] = template
            self.kinds[name] = kind

    def find(self, name: str, rules: Profile) -> Template | None:
        found = self.known.get(name.upper())
        if not found:
            return None
        for family in (*rules.families, ""):
            if family in found:
                return found[family]
        return next(iter(found.values())) if rules.name in ("auto", "standard") else None

    def call(self, name: str, args: list[str], dialect: str | Profile = "standard") -> str:
        """The Spark SQL of a call."""
        rules = profile(dialect)
        template = self.find(name, rules)
        if template is None:
            raise Unsupported(f"{rules.name} has no function {name}")
        return render(template, args, rules)

    def names(self, dialect: str | Profile | None = None) -> list[str]:
        if dialect is None:
            return sorted(self.known)
        rules = profile(dialect)
        return sorted(n for n in self.known if self.find(n, rules) is not None)


@lru_cache(1)
def catalog() -> FunctionCatalog:
    """All definitions of this package."""
    from polyquery.functions import aggregate, conversion, hashing, json, math, session, strings, temporal, vectors

    out = FunctionCatalog()
    for module in (math, strings, conversion, temporal, json, vectors, hashing, session, aggregate):
        module.define(out)
    return out
