"""Names to unique ids: refs, sources, macros and what depends on what."""

from __future__ import annotations

from weftline import template
from weftline.errors import ProjectError
from weftline.model import Graph, Macro, Node, Resource, Source, Test, UnitTest
from weftline.properties import literal_call

#: adapters that may use another one's macros
FALLBACK = {"redshift": "postgres", "databricks": "spark"}


def find_ref(graph: Graph, package: str | None, name: str, own: str) -> Node:
    """A model or seed: that of the named package, else of the own one, else the only one of that name."""
    found = [r for r in graph.of("model", "seed", enabled=False) if r.name == name and (package is None or r.package == package)]
    mine = [r for r in found if r.package == own]
    on = [r for r in mine if r.enabled] or ([] if mine else [r for r in found if r.enabled])
    if len(on) == 1:
        return on[0]
    if len(on) > 1:
        raise ProjectError(f"ambiguous ref: {name}")
    if found:
        raise ProjectError(f"ref targets a disabled model: {name}")
    raise ProjectError(f"unresolved ref: {name}")


def find_source(graph: Graph, source: str, name: str, own: str) -> Source:
    found = [r for r in graph.of("source") if r.source_name == source and r.name == name]
    mine = [r for r in found if r.package == own] or found
    if len(mine) != 1:
        raise ProjectError(f"{'ambiguous' if mine else 'unresolved'} source: {source}.{name}")
    return mine[0]


def find_macro(graph: Graph, called: str, own: str) -> Macro | None:
    """A macro that is called by its name (own package, then the project) or with its package."""
    space, _, name = called.rpartition(".")
    for package in [space] if space else [own, graph.project]:
        if found := graph.macros.get(f"macro.{package}.{name}"):
            return found
    return None


def prefixes(adapter: str) -> list[str]:
    return [adapter, *([FALLBACK[adapter]] if adapter in FALLBACK else []), "default"]


def find_dispatched(graph: Graph, name: str, space: str | None, own: str) -> Macro | None:
    if space and space in graph.dispatch:
        packages = graph.dispatch[space]
    elif space:
        packages = [graph.project, space]
    else:
        packages = list(dict.fromkeys([own, graph.project]))
    for package in packages:
        for prefix in prefixes(graph.target.type):
            if found := graph.macros.get(f"macro.{package}.{prefix}__{name}"):
                return found
    return None


def _macro_ids(graph: Graph, calls: list[str], dispatched: list, own: str, where: str, self_id: str | None = None) -> list[str]:
    found: list[str] = []
    for called in calls:
        macro = find_macro(graph, called, own)
        if macro is None and self_id and "." not in called:  # of any other package
            macro = next((m for k, m in sorted(graph.macros.items()) if m.name == called), None)
        if macro is None:
            raise ProjectError(f"unresolved macro reference in {where}: {called}")
        if macro.unique_id != self_id:
            template.add_once(found, macro.unique_id)
    for name, space in dispatched:
        macro = find_dispatched(graph, name, space, own)
        if macro is None:
            raise ProjectError(f"unresolved macro reference in {where}: adapter.dispatch of {name}")
        if macro.unique_id != self_id:
            template.add_once(found, macro.unique_id)
    return found


def resolve(graph: Graph) -> None:
    """Fill ``depends_on`` of everything."""
    _no_duplicates(graph)
    for macro in graph.macros.values():
        if macro.kind == "materialization":
            continue
        try:
            found = template.scan(macro.body, graph.vars, tuple(p for p, _ in macro.params) or ("_",))
        except template.TemplateError:
            continue  # an error where it is used
        macro.depends_on = _macro_ids(graph, found.calls, found.dispatched, macro.package, macro.unique_id, macro.unique_id)
    for r in graph.resources.values():
        if isinstance(r, Source):
            continue
        dispatched = r.meta.pop("_dispatched", [])
        if not r.enabled:
            continue
        if isinstance(r, Test) and not r.singular:
            r.macros = [r.macro] if r.macro else []
        else:
            r.macros = _macro_ids(graph, r.macros, dispatched, r.package, r.unique_id)
        found = [find_ref(graph, p, n, r.package).unique_id for p, n in r.refs]
        found += [find_source(graph, s, n, r.package).unique_id for s, n in r.sources]
        if isinstance(r, UnitTest):
            model = next((m for m in graph.of("model") if m.name == r.model and m.package == r.package), None) or next((m for m in graph.of("model") if m.name == r.model), None)
            if model is None:
                raise ProjectError(f"unit test {r.name} references a missing model: {r.model}")
            found.append(model.unique_id)
        for x in found:
            template.add_once(r.depends_on, x)
    for r in graph.resources.values():  # a test of something that is off is off
        if isinstance(r, Test) and r.attached and not graph.resources[r.attached].enabled:
            r.enabled = False


def relationship_parent(graph: Graph, test: Test) -> Resource:
    """The parent side of a relationships test; the attached node itself if it names itself."""
    assert test.spec and test.attached
    call = literal_call(test.spec.to)
    if call and call[0] == "source" and call[1]:
        return find_source(graph, call[1], call[2], test.package)
    if call and call[0] == "ref":
        return find_ref(graph, call[1], call[2], test.package)
    raise ProjectError(f"{test.name}: `to` takes a literal ref or source call")


def _no_duplicates(graph: Graph) -> None:
    seen: dict[tuple[str, str, str], str] = {}
    for r in graph.resources.values():
        if r.kind in ("model", "seed") and r.enabled:
            key = ("node", r.package, r.name)
            if key in seen:
                raise ProjectError(f"duplicate model or seed name: {r.name}")
            seen[key] = r.unique_id
