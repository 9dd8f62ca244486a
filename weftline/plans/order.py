"""Order of execution."""

from __future__ import annotations

from weftline.errors import ProjectError
from weftline.model import Graph, Node


def execution_order(graph: Graph, chosen: list[Node]) -> list[Node]:
    """Parents first; among those that are ready, by unique id.  Ephemeral parents are looked through."""
    left = {n.unique_id: n for n in sorted(chosen, key=lambda n: n.unique_id)}
    waits = {k: {p for p in built_parents(graph, k) if p in left} for k in left}
    done: list[Node] = []
    placed: set[str] = set()
    while left:
        ready = [k for k in left if waits[k] <= placed]
        if not ready:
            raise ProjectError(f"selected models contain a cycle: {', '.join(sorted(left))}")
        for k in list(left):  # a node that becomes ready in this round follows at once
            if waits[k] <= placed:
                done.append(left.pop(k))
                placed.add(k)
    return done


def built_parents(graph: Graph, unique_id: str) -> set[str]:
    """Models, seeds and sources that a resource reads, with ephemeral models replaced by their parents."""
    found: set[str] = set()
    seen: set[str] = set()
    todo = list(graph.resources[unique_id].depends_on)
    while todo:
        k = todo.pop()
        if k in seen:
            continue
        seen.add(k)
        r = graph.resources[k]
        if isinstance(r, Node) and r.materialized == "ephemeral":
            todo += r.depends_on
        else:
            found.add(k)
    return found
