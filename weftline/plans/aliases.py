"""Named selections of ``selectors.yml``."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from weftline.config import mapping, read_yaml
from weftline.errors import ProjectError
from weftline.plans.select import Selector, parse, parse_term
from weftline.properties import entries, named

FILE = "selectors.yml"
METHODS = ("name", "fqn", "path", "file", "tag", "resource_type", "source", "exposure", "test_type", "package", "config.materialized")


class Aliases:
    """A definition gives (selected, excluded); excluded ids are taken away at the end."""

    def __init__(self, root: str, selector: Selector):
        file = Path(root) / FILE
        if not file.is_file():
            raise ProjectError(f"missing {FILE}")
        raw = mapping(read_yaml(file.read_text(), FILE), FILE)
        self.selector = selector
        self.definitions: dict[str, Any] = {}
        for entry in entries(raw.get("selectors"), FILE):
            name = named(entry, FILE)
            if name in self.definitions or "definition" not in entry:
                raise ProjectError(f"{FILE}: {name} is defined twice or not at all")
            self.definitions[name] = entry["definition"]

    def resolve(self, names: str) -> set[str]:
        found: set[str] = set()
        for name in names.split():
            if name not in self.definitions:
                raise ProjectError(f"unknown selector: {name}")
            found |= self._value(self.definitions[name], (name,))
        return found

    def _value(self, raw: Any, inside: tuple[str, ...]) -> set[str]:
        if isinstance(raw, str):
            return self.selector.union(parse(raw))
        if isinstance(raw, list):
            return self._list(raw, inside, set.union)
        raw = mapping(raw, FILE)
        if "union" in raw or "intersection" in raw:
            kind = "union" if "union" in raw else "intersection"
            if set(raw) - {kind, "exclude"}:
                raise ProjectError(f"{FILE}: unsupported keys beside {kind}")
            found = self._list(raw[kind], inside, set.union if kind == "union" else set.intersection)
            return found - (self._list(raw["exclude"], inside, set.union) if raw.get("exclude") else set())
        if "method" in raw:
            method, value = str(raw["method"]), str(raw.get("value") or "")
            if method == "selector":
                if value in inside or value not in self.definitions:
                    raise ProjectError(f"{FILE}: selector {value} is unknown or contains itself")
                found = self._value(self.definitions[value], (*inside, value))
            else:
                if method not in METHODS:
                    raise ProjectError(f"{FILE}: unsupported method {method}")
                on = lambda k: str(raw.get(k, "false")).lower() == "true"
                body = f"{method}:{value}" if method not in ("name",) else value
                text = f"{'@' if on('childrens_parents') else ''}{str(raw.get('parents_depth') or '') + '+' if on('parents') else ''}{body}{'+' + str(raw.get('children_depth') or '') if on('children') else ''}"
                found = self.selector.term(parse_term(text))
            return found - (self._list(raw["exclude"], inside, set.union) if raw.get("exclude") else set())
        if len(raw) == 1:
            (method, value), = raw.items()
            if method in METHODS and isinstance(value, str):
                return self.selector.term(parse_term(value if method == "name" else f"{method}:{value}"))
        raise ProjectError(f"{FILE}: unsupported definition {raw}")

    def _list(self, raw: Any, inside: tuple[str, ...], how) -> set[str]:
        if not isinstance(raw, list) or not raw:
            raise ProjectError(f"{FILE}: a non-empty list is needed")
        kept = [x for x in raw if not (isinstance(x, dict) and set(x) == {"exclude"})]
        gone = [x["exclude"] for x in raw if isinstance(x, dict) and set(x) == {"exclude"}]
        if not kept:
            raise ProjectError(f"{FILE}: something must be selected")
        found = how(*(self._value(x, inside) for x in kept))
        for x in gone:
            found = found - self._list(x, inside, set.union)
        return found
