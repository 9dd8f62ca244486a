"""Selection of resources.

An expression is a union (white space) of intersections (commas) of terms.  A term is a method and a
value with optional graph operators: ``+x`` ancestors, ``x+`` descendants, ``2+x+1`` with depths, and
``@x`` descendants with all their ancestors.  Selecting a node selects its tests (eagerly).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import PurePosixPath

from weftline.errors import ProjectError
from weftline.model import KINDS, Exposure, Graph, Node, Resource, Source, Test, UnitTest
from weftline.plans.glob import is_wild, match
from weftline.plans.state import FRESHNESS, RESULTS, State

METHODS = ("name", "fqn", "tag", "path", "file", "package", "resource_type", "test_type", "source", "exposure", "unit_test", "config.materialized", "state", "result", "source_status")
_VALUES = {"resource_type": KINDS, "test_type": ("generic", "singular", "data", "unit"), "state": ("new",), "result": RESULTS, "source_status": FRESHNESS}
_TERM = re.compile(r"(?P<at>@)?(?P<up>(?P<up_n>\d+)?\+)?(?P<body>[^+@]+?)(?P<down>\+(?P<down_n>\d+)?)?")


@dataclass(frozen=True)
class Term:
    method: str
    value: str
    at: bool = False
    up: int | None = None  # None: no; -1: any depth
    down: int | None = None


def parse_term(text: str) -> Term:
    m = _TERM.fullmatch(text)
    if not m or m["at"] and (m["up"] or m["down"]):
        raise ProjectError(f"unsupported selector: {text}")
    method, colon, value = m["body"].partition(":")
    if not colon:
        method, value = "name", m["body"]
    if method not in METHODS or not value or method in _VALUES and value not in _VALUES[method]:
        raise ProjectError(f"unsupported selector: {text}")
    depth = lambda on, n: None if not on else int(n) if n else -1
    return Term(method, value, bool(m["at"]), depth(m["up"], m["up_n"]), depth(m["down"], m["down_n"]))


def parse(text: str) -> list[list[Term]]:
    """A union of intersections."""
    out = []
    for part in text.split():
        terms = part.split(",")
        if not all(terms):
            raise ProjectError(f"unsupported selector: {part}")
        out.append([parse_term(t) for t in terms])
    return out


class Selector:
    def __init__(self, graph: Graph, state: State | None = None):
        self.graph, self.state = graph, state or State()
        self.down = graph.children()
        self.kept: dict[Term, set[str]] = {}

    def select(self, select: str | None = None, exclude: str | None = None, resource_type: str | None = None) -> list[Resource]:
        """Enabled resources, by unique id."""
        if resource_type and resource_type not in KINDS:
            raise ProjectError(f"unsupported resource type: {resource_type}")
        every = {k for k, r in self.graph.resources.items() if r.enabled}
        chosen = self.expression(select) if select and select.strip() else every
        if exclude and exclude.strip():
            chosen = chosen - self.expression(exclude)
        found = [self.graph.resources[k] for k in sorted(chosen & every)]
        return [r for r in found if resource_type in (None, r.kind)]

    def expression(self, text: str) -> set[str]:
        return self.union(parse(text))

    def union(self, parts: Iterable[list[Term]]) -> set[str]:
        found: set[str] = set()
        for terms in parts:
            found |= set.intersection(*(self.term(t) for t in terms))
        return found

    def term(self, t: Term) -> set[str]:
        if t not in self.kept:
            own = {k for k, r in self.graph.resources.items() if r.enabled and self.matches(r, t.method, t.value)}
            found = set(own)
            if t.up is not None:
                found |= self.reach(own, self.graph.parents, t.up)
            if t.down is not None:
                found |= self.reach(own, lambda k: self.down.get(k, []), t.down)
            if t.at:
                below = own | self.reach(own, lambda k: self.down.get(k, []), -1)
                found = below | self.reach(below, self.graph.parents, -1)
            self.kept[t] = found | self._tests(own, t.method)
        return self.kept[t]

    def _tests(self, own: set[str], method: str) -> set[str]:
        """Tests that come with models and seeds which are selected by name or tag.

        Paths, files and packages are those of the test itself, and a source's tests come by their own names.
        """
        if method not in ("name", "fqn", "tag"):
            return set()
        nodes = {k for k in own if isinstance(self.graph.resources[k], Node)}
        found = set()
        for k, r in self.graph.resources.items():
            if isinstance(r, Test) and r.enabled and ((r.attached in nodes) if not r.singular else bool(nodes & set(r.depends_on))):
                found.add(k)
        return found

    def reach(self, start: set[str], step, depth: int) -> set[str]:
        """What can be reached in at most ``depth`` steps (-1: any number)."""
        seen, now = set(start), set(start)
        while now and depth:
            now = {y for x in now for y in step(x) if self.graph.resources[y].enabled} - seen
            seen |= now
            depth -= 1
        return seen

    def matches(self, r: Resource, method: str, value: str) -> bool:
        if method in ("name", "fqn"):
            return self._named(r, value)
        if method == "tag":
            return any(match(value, t) for t in self._tags(r))
        if method == "path":
            return self._path(r, value)
        if method == "file":
            name = PurePosixPath(r.file).name
            return bool(name) and (match(value, name) or match(value, name.rsplit(".", 1)[0]))
        if method == "package":
            return match(self.graph.project if value == "this" else value, r.package)
        if method == "resource_type":
            return r.kind == value
        if method == "test_type":
            if isinstance(r, UnitTest):
                return value == "unit"
            return isinstance(r, Test) and (value == "data" or value == ("singular" if r.singular else "generic"))
        if method == "source":
            return isinstance(r, Source) and any(match(value, x) for x in (r.source_name, r.search_name, f"{r.package}.{r.search_name}"))
        if method == "exposure":
            return isinstance(r, Exposure) and any(match(value, x) for x in (r.name, f"{r.package}.{r.name}"))
        if method == "unit_test":
            return isinstance(r, UnitTest) and any(match(value, x) for x in (r.name, f"{r.model}.{r.name}", f"{r.package}.{r.model}.{r.name}"))
        if method == "config.materialized":
            return isinstance(r, Node) and r.kind in ("model", "analysis") and r.materialized == value
        if method == "state":
            return r.unique_id not in self.state.known()
        if method == "result":
            return self.state.results().get(r.unique_id) == value
        return isinstance(r, Source) and self.state.freshness().get(r.unique_id) == value

    def _named(self, r: Resource, value: str) -> bool:
        if match(value, r.name) or match(value, r.unique_id):
            return True
        fqn = r.fqn
        if is_wild(value):
            return any(match(value, ".".join(fqn[i:])) for i in (0, 1))
        parts = value.split(".")
        return fqn[: len(parts)] == parts or fqn[1 : len(parts) + 1] == parts

    def _tags(self, r: Resource) -> list[str]:
        tags = list(r.tags)
        if isinstance(r, Test):
            for k in [r.attached] if r.attached else r.depends_on:
                tags += self.graph.resources[k].tags
        return tags

    def _path(self, r: Resource, value: str) -> bool:
        paths = [r.file] if r.file else []
        if r.kind == "model" and r.patch_path:
            paths.append(r.patch_path.split("://")[-1])
        if not is_wild(value):
            return any(value in p for p in paths)
        return any(match(value, str(p), across=False) for path in paths for p in (PurePosixPath(path), *PurePosixPath(path).parents))
