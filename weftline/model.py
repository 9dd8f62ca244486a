"""What a project is made of: plain records on the driver, some hundreds of them at most."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: kinds of resources, as selectors and listings name them
KINDS = ("model", "analysis", "seed", "source", "exposure", "test", "unit_test")


@dataclass
class Column:
    name: str
    description: str = ""
    tags: list[str] = field(default_factory=list)
    tests: list[TestSpec] = field(default_factory=list)
    doc_blocks: list[str] = field(default_factory=list)


@dataclass
class TestConfig:
    where: str | None = None
    limit: int | None = None
    severity: str = "ERROR"
    warn_if: str = "!= 0"
    error_if: str = "!= 0"
    store_failures: bool | None = None
    enabled: bool = True
    tags: list[str] = field(default_factory=list)


@dataclass
class TestSpec:
    """A data test as a YAML file declares it."""

    name: str
    namespace: str | None = None
    values: list[str] = field(default_factory=list)
    quote: bool | None = None
    column: str | None = None
    config: TestConfig = field(default_factory=TestConfig)
    to: str = ""
    field: str = ""


@dataclass
class Threshold:
    count: int | None = None
    period: str | None = None

    def seconds(self) -> float | None:
        size = {"minute": 60, "hour": 3600, "day": 86400}.get(self.period or "")
        return None if self.count is None or size is None else float(self.count * size)


@dataclass
class Freshness:
    warn_after: Threshold | None = None
    error_after: Threshold | None = None
    filter: str | None = None


@dataclass
class Resource:
    """Any node of the graph.  ``depends_on`` holds unique ids; macros are apart."""

    kind: str
    package: str
    name: str
    unique_id: str
    path: str = ""  # within its resource folder
    file: str = ""  # within the project
    raw: str = ""
    description: str = ""
    doc_blocks: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    enabled: bool = True
    columns: dict[str, Column] = field(default_factory=dict)
    refs: list[tuple[str | None, str]] = field(default_factory=list)
    sources: list[tuple[str, str]] = field(default_factory=list)
    macros: list[str] = field(default_factory=list)
    depends_on: list[str] = field(default_factory=list)
    patch_path: str | None = None
    compiled: str | None = None
    extra_ctes: list[tuple[str, str]] = field(default_factory=list)
    meta: dict[str, Any] = field(default_factory=dict)

    @property
    def fqn(self) -> list[str]:
        folders = self.path.rsplit(".", 1)[0].split("/")[:-1] if self.path else []
        return [self.package, *folders, self.name]

    @property
    def search_name(self) -> str:
        return self.name

    @property
    def selector(self) -> str:
        return ".".join(self.fqn)


@dataclass
class Node(Resource):
    """A model, seed or analysis."""

    materialized: str = "view"
    schema: str | None = None
    alias: str | None = None
    store_failures: bool | None = None
    docs: dict[str, Any] = field(default_factory=lambda: {"show": True, "node_color": None})
    tests: list[TestSpec] = field(default_factory=list)
    quote_columns: bool | None = None
    column_types: dict[str, str] = field(default_factory=dict)
    inline: dict[str, Any] = field(default_factory=dict)
    root: str = ""  # folder of its package

    @property
    def identifier(self) -> str:
        return (self.alias or "").strip() or self.name


@dataclass
class Source(Resource):
    source_name: str = ""
    schema: str | None = None
    database: str | None = None
    identifier: str | None = None
    quoting: dict[str, bool] = field(default_factory=dict)
    loaded_at_field: str | None = None
    loaded_at_query: str | None = None
    freshness: Freshness | None = None
    source_description: str = ""
    tests: list[TestSpec] = field(default_factory=list)

    @property
    def fqn(self) -> list[str]:
        folders = self.path.rsplit(".", 1)[0].split("/")[:-1] if self.path else []
        return [self.package, *folders, self.source_name, self.name]

    @property
    def search_name(self) -> str:
        return f"{self.source_name}.{self.name}"

    @property
    def selector(self) -> str:
        return f"source:{self.package}.{self.source_name}.{self.name}"


@dataclass
class Test(Resource):
    """A data test: generic (attached to a node or source) or singular (a file)."""

    alias: str = ""
    singular: bool = False
    spec: TestSpec | None = None
    attached: str | None = None
    column: str | None = None
    config: TestConfig = field(default_factory=TestConfig)
    macro: str | None = None

    @property
    def identifier(self) -> str:
        return self.alias or self.name


@dataclass
class Exposure(Resource):
    type: str = ""
    maturity: str | None = None
    url: str | None = None
    owner: dict[str, str] = field(default_factory=dict)

    @property
    def selector(self) -> str:
        return f"exposure:{self.package}.{self.name}"


@dataclass
class UnitTest(Resource):
    model: str = ""
    given: list[dict[str, Any]] = field(default_factory=list)
    expect: dict[str, Any] = field(default_factory=dict)

    @property
    def fqn(self) -> list[str]:
        folders = self.path.rsplit(".", 1)[0].split("/")[:-1] if self.path else []
        return [self.package, *folders, self.model, self.name]

    @property
    def selector(self) -> str:
        return f"unit_test:{self.package}.{self.model}.{self.name}"


@dataclass
class Macro:
    package: str
    name: str
    unique_id: str
    file: str
    text: str  # the whole block
    body: str
    params: list[tuple[str, str | None]]
    kind: str = "macro"
    description: str = ""
    meta: dict[str, Any] = field(default_factory=dict)
    docs: dict[str, Any] = field(default_factory=lambda: {"show": True, "node_color": None})
    patch_path: str | None = None
    arguments: list[dict[str, Any]] = field(default_factory=list)
    languages: list[str] | None = None
    depends_on: list[str] = field(default_factory=list)


@dataclass
class Target:
    """The chosen output of a profile."""

    profile: str = "default"
    name: str = "dev"
    type: str = "spark"
    schema: str = "main"
    path: str | None = None


@dataclass
class Graph:
    project: str
    root: str
    target: Target
    target_path: str = "target"
    vars: dict[str, str] = field(default_factory=dict)
    resources: dict[str, Resource] = field(default_factory=dict)
    macros: dict[str, Macro] = field(default_factory=dict)
    docs: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # id: (name, file, text)
    dispatch: dict[str, list[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def of(self, *kinds: str, enabled: bool = True) -> list[Any]:
        """Resources of the kinds, by unique id."""
        return [r for _, r in sorted(self.resources.items()) if r.kind in kinds and (r.enabled or not enabled)]

    def parents(self, unique_id: str) -> list[str]:
        found = self.resources[unique_id]
        return [] if isinstance(found, Source) else found.depends_on

    def children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {k: [] for k in sorted(self.resources)}
        for k, r in sorted(self.resources.items()):
            if r.enabled:
                for p in r.depends_on:
                    out.setdefault(p, []).append(k)
        return out

    def relation(self, r: Resource) -> str:
        """The quoted name by which SQL reaches a node or source."""
        if isinstance(r, Source):
            parts = [("database", r.database), ("schema", r.schema or r.source_name), ("identifier", r.identifier or r.name)]
            return ".".join(quoted(x) if r.quoting.get(k, True) else x for k, x in parts if x and x.strip())
        assert isinstance(r, Node)
        return f"{quoted(self.schema_of(r))}.{quoted(r.identifier)}"

    def schema_of(self, node: Node) -> str:
        custom = (node.schema or "").strip()
        return f"{self.target.schema}_{custom}" if custom else self.target.schema


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
