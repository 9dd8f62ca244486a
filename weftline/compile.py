"""Templates of a graph to SQL."""

from __future__ import annotations

from collections.abc import Callable

from weftline.errors import ProjectError
from weftline.functions.dialect import inject_ctes, trim_terminator
from weftline.model import Graph, Macro, Node, Resource, Source, Test, literal, quoted
from weftline.naming import BUILT_IN
from weftline.resolve import find_dispatched, find_macro, find_ref, find_source, relationship_parent
from weftline.template import Output, Renderer, Text, TemplateError, parse


class Compiler:
    """``bind`` may replace the relation name of a node or source (for unit tests)."""

    def __init__(self, graph: Graph, bind: Callable[[Resource], str | None] | None = None):
        self.graph, self.bind = graph, bind or (lambda r: None)

    def relation(self, r: Resource) -> str:
        bound = self.bind(r)
        if bound:
            return bound
        if isinstance(r, Node) and r.materialized == "ephemeral":
            return f"__dbt__cte__{r.identifier}"
        return self.graph.relation(r)

    def _renderer(self, r: Resource) -> Renderer:
        g, t = self.graph, self.graph.target
        context = {"target.name": t.name, "target.target_name": t.name, "target.schema": t.schema, "target.type": t.type, "target.profile_name": t.profile}
        if isinstance(r, Node):
            context |= {"this": g.relation(r), "this.schema": g.schema_of(r), "this.name": r.identifier, "this.table": r.identifier, "this.identifier": r.identifier}

        def macro(name: str, inside: Macro | None) -> Macro:
            found = find_macro(g, name, inside.package if inside else r.package)
            if found is None:
                raise TemplateError(f"unresolved macro reference: {name}")
            return found

        def dispatch(name: str, space: str | None, inside: Macro | None) -> Macro:
            found = find_dispatched(g, name, space, inside.package if inside else r.package)
            if found is None:
                raise TemplateError(f"unresolved macro reference: adapter.dispatch of {name}")
            return found

        return Renderer(g.vars, lambda p, n: self.relation(find_ref(g, p, n, r.package)), lambda s, n: self.relation(find_source(g, s, n, r.package)), macro, dispatch, context)

    def plain(self, r: Resource) -> str:
        """The SQL of a file, without the tables that ephemeral parents stand for."""
        try:
            return self._renderer(r).render(r.raw)
        except TemplateError as e:
            raise ProjectError(f"{r.file}: {e}") from e

    def ctes(self, r: Resource) -> list[tuple[str, str]]:
        """Ephemeral parents, depth first, each once."""
        found: dict[str, tuple[str, str]] = {}

        def visit(k: str, way: tuple[str, ...]) -> None:
            node = self.graph.resources[k]
            if not isinstance(node, Node) or node.materialized != "ephemeral" or k in found or self.bind(node):
                return
            if k in way:
                raise ProjectError(f"ephemeral models contain a cycle: {' -> '.join((*way, k))}")
            for p in node.depends_on:
                visit(p, (*way, k))
            found[k] = (f"__dbt__cte__{node.identifier}", trim_terminator(self.plain(node)))

        for p in r.depends_on:
            visit(p, (r.unique_id,))
        r.extra_ctes = [(k, f" {n} as (\n{s}\n)") for k, (n, s) in found.items()]
        return list(found.values())

    def model(self, r: Node) -> str:
        sql = self.plain(r)
        if r.kind == "analysis":
            return sql
        return inject_ctes(sql, self.ctes(r))

    # tests

    def test(self, t: Test) -> str:
        """The query for the failing rows; ``where`` and ``limit`` included."""
        if t.singular:
            sql = inject_ctes(trim_terminator(self.plain(t)), self.ctes(t))
            if t.config.where:
                sql = f"select * from (\n{sql}\n) dbt_subquery where {t.config.where}"
            return sql if t.config.limit is None else f"select * from (\n{sql}\n) dbt_subquery limit {t.config.limit}"
        sql = inject_ctes(self._generic(t), self.ctes(t))
        return sql if t.config.limit is None else f"{sql}\nlimit {t.config.limit}"

    def _generic(self, t: Test) -> str:
        assert t.spec and t.attached
        if not t.column:
            raise ProjectError(f"{t.name}: a column is needed")
        of = self.relation(self.graph.resources[t.attached])
        if t.config.where:
            of = f"(select * from {of} where {t.config.where}) dbt_subquery"
        if t.macro:
            return self._custom(t, of)
        column = quoted(t.column)
        if t.spec.name == "not_null":
            return f"select {column}\nfrom {of}\nwhere {column} is null"
        if t.spec.name == "unique":
            return f"select {column} as unique_field, count(*) as n_records\nfrom {of}\nwhere {column} is not null\ngroup by {column}\nhaving count(*) > 1"
        if t.spec.name == "accepted_values":
            values = ", ".join(v if t.spec.quote is False else literal(v) for v in t.spec.values)
            return f"with all_values as (\nselect {column} as value_field, count(*) as n_records\nfrom {of}\ngroup by {column}\n)\nselect *\nfrom all_values\nwhere value_field not in ({values})"
        parent, field = self.relation(relationship_parent(self.graph, t)), quoted(t.spec.field)
        return f"with child as (\nselect {column} as from_field\nfrom {of}\nwhere {column} is not null\n), parent as (\nselect {field} as to_field\nfrom {parent}\n)\nselect from_field\nfrom child\nleft anti join parent on child.from_field = parent.to_field"

    def _custom(self, t: Test, of: str) -> str:
        macro = self.graph.macros[t.macro or ""]
        if [p for p, _ in macro.params] != ["model", "column_name"]:
            raise ProjectError(f"custom test {macro.name} must take (model, column_name)")
        given = {"model": of, "column_name": t.column}
        out = []
        for node in parse(macro.body):
            if isinstance(node, Text):
                out.append(node.text)
            elif isinstance(node, Output) and getattr(node.value, "path", None) in given:
                out.append(given[node.value.path])
            else:
                raise ProjectError(f"custom test {macro.name}: only static SQL, model and column_name are supported")
        return trim_terminator("".join(out).strip())


def is_built_in(t: Test) -> bool:
    return bool(t.spec) and t.macro is None and t.spec.name in BUILT_IN


def relation_parts(graph: Graph, r: Resource) -> tuple[str, str]:
    """Schema and identifier of a node or source."""
    if isinstance(r, Source):
        return r.schema or r.source_name, r.identifier or r.name
    assert isinstance(r, Node)
    return graph.schema_of(r), r.identifier
