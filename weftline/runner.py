"""Commands: what is run, what is blocked by failures, and what is written."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from weftline import artifacts
from weftline.artifacts import FreshnessResult, Result
from weftline.compile import Compiler, is_built_in, relation_parts
from weftline.config import load_project
from weftline.errors import ProjectError, ResourceFailure
from weftline.loader import Loader
from weftline.model import Graph, Node, Resource, Source, Test, UnitTest
from weftline.operators import checks, freshness, unit_tests
from weftline.plans.aliases import Aliases
from weftline.plans.order import built_parents, execution_order
from weftline.plans.select import Selector
from weftline.plans.state import State
from weftline.properties import literal_call
from weftline.resolve import find_ref, find_source, relationship_parent
from weftline.sources.backend import MATERIALIZATIONS, Backend, engine_settings, tick
from weftline.sources.files import inside

AUDIT = "dbt_test__audit"
ADAPTERS = ("spark", "duckdb", "databricks")


@dataclass
class Options:
    project_dir: str = "."
    profiles_dir: str | None = None
    profile: str | None = None
    target: str | None = None
    vars: str | None = None
    target_path: str | None = None
    select: str | None = None
    exclude: str | None = None
    selector: str | None = None
    resource_type: str | None = None
    state: str | None = None
    threads: int = 1
    output: str = "text"
    output_keys: list[str] | None = None
    at: datetime | None = None  # the instant of freshness checks; now if None


class Project:
    """A loaded project.  Only commands that touch data need a session."""

    def __init__(self, options: Options, session: Callable[[Graph], SparkSession] | None = None):
        self.options = options
        self.graph = Loader(options.project_dir, options.profiles_dir, options.profile, options.target, options.vars, options.target_path).load()
        self.selector = Selector(self.graph, State(options.state))
        self.compiler = Compiler(self.graph)
        self._session = session
        self._backend: Backend | None = None
        self.folder = Path(options.project_dir) / self.graph.target_path

    @property
    def backend(self) -> Backend:
        if self._backend is None:
            if self.graph.target.type not in ADAPTERS:
                raise ProjectError(f"only {', '.join(ADAPTERS)} targets can be run, not {self.graph.target.type}")
            self._backend = Backend(self._session(self.graph) if self._session else SparkSession.builder.getOrCreate())
        return self._backend

    def chosen(self) -> list[Resource]:
        o = self.options
        if not o.selector:
            return self.selector.select(o.select, o.exclude, o.resource_type)
        ids = Aliases(o.project_dir, self.selector).resolve(o.selector)
        if o.select:
            ids |= self.selector.expression(o.select)
        if o.exclude:
            ids -= self.selector.expression(o.exclude)
        return [r for k, r in sorted(self.graph.resources.items()) if k in ids and r.enabled and o.resource_type in (None, r.kind)]

    # commands without data

    def parse(self) -> dict[str, int]:
        self.write_manifest()
        return {k: len(self.graph.of(k)) for k in ("model", "analysis", "seed", "source", "exposure", "unit_test")}

    def list(self) -> list[str]:
        import json

        o = self.options
        out = []
        for r in self.chosen():
            if o.output == "json":
                out.append(json.dumps(artifacts.listed(self.graph, r, o.output_keys)))
            else:
                out.append({"name": r.search_name, "path": r.file, "selector": r.selector}.get(o.output, r.unique_id))
        return out

    def needed(self, found: list[Resource], what: str) -> list[Resource]:
        """``found``, or an error before anything is written if nothing was chosen."""
        if not found:
            raise ProjectError(f"the selection holds no {what}")
        return found

    def compile(self, tests: bool = True, analyses: bool = True) -> dict[str, int]:
        found = self.chosen()
        self.needed([r for r in found if r.kind in ("model", "analysis") or isinstance(r, Test)], "model, analysis or data test to compile")
        self.compile_resources(found, tests, analyses)
        self.write_manifest()
        return {k: sum(r.kind == k and r.compiled is not None for r in found) for k in ("model", "analysis", "test")}

    def compile_resources(self, found: Iterable[Resource], tests: bool = True, analyses: bool = False) -> None:
        for r in found:
            if isinstance(r, Node) and (r.kind == "model" or analyses and r.kind == "analysis"):
                r.compiled = self.compiler.model(r)
            elif isinstance(r, Test) and tests:
                r.compiled = self.compiler.test(r)
            else:
                continue
            file = Path(self.options.project_dir) / artifacts.compiled_path(self.graph, r)
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(r.compiled)

    def write_manifest(self) -> None:
        artifacts.write(self.folder, "manifest.json", artifacts.manifest(self.graph))

    # commands with data

    def run(self) -> list[Result]:
        return self._execute(self.needed([r for r in self.chosen() if r.kind == "model"], "model to run"))

    def seed(self) -> list[Result]:
        return self._execute(self.needed([r for r in self.chosen() if r.kind == "seed"], "seed to load"), stop=True)

    def test(self) -> list[Result]:
        return self._execute(self.needed([r for r in self.chosen() if isinstance(r, Test | UnitTest)], "test to run"))

    def build(self) -> list[Result]:
        """Seeds, models, tests and unit tests; what can't be run (sources, exposures, analyses) is passed over."""
        found = self.needed([r for r in self.chosen() if isinstance(r, Test | UnitTest) or r.kind in ("model", "seed")], "seed, model or test to build")
        if any(r.kind == "seed" for r in found):
            self._attached(found)
        return self._execute(found)

    def _attached(self, found: list[Resource]) -> None:
        """With seeds, every data test must be of nodes that are built as well."""
        built = {r.unique_id for r in found}
        for t in found:
            if isinstance(t, Test):
                needs = [k for k in t.depends_on if k.startswith(("model.", "seed."))] if t.singular else [t.attached]
                if missing := [k for k in needs if k not in built]:
                    raise ProjectError(f"{t.unique_id} tests {missing[0]}, which is not selected")

    def _execute(self, found: list[Resource], stop: bool = False) -> list[Result]:
        nodes = [r for r in found if isinstance(r, Node) and r.materialized != "ephemeral"]
        for n in nodes:  # before anything is done
            if n.kind == "model" and n.materialized not in MATERIALIZATIONS:
                raise ProjectError(f"{n.unique_id}: only table and view materializations can be run, not {n.materialized}")
        for u in found:
            if isinstance(u, UnitTest):
                self._validate(u)
        order = execution_order(self.graph, nodes)
        backend = self.backend
        self.compile_resources(found)
        self.write_manifest()
        with engine_settings(backend.spark):
            results = _Run(self, order, [r for r in found if isinstance(r, Test)], [r for r in found if isinstance(r, UnitTest)], stop).go()
        artifacts.write(self.folder, "run_results.json", artifacts.run_results(results))
        if any(r.status == "error" and r.unique_id.split(".")[0] in ("model", "seed") for r in results):
            raise ResourceFailure("one or more selected resources failed", results)
        if any(r.status in ("fail", "error") for r in results):
            raise ResourceFailure("one or more tests failed", results)
        return results

    def source_freshness(self) -> list[FreshnessResult]:
        found = [r for r in self.chosen() if isinstance(r, Source) and r.freshness and (r.freshness.warn_after or r.freshness.error_after)]
        results = []
        with engine_settings(self.backend.spark):
            for s in found:
                assert s.freshness
                why = freshness.unsupported(s.loaded_at_field, s.loaded_at_query, s.freshness)
                if why:
                    results.append(FreshnessResult(s.unique_id, "runtime error", error=why))
                    continue
                try:
                    if s.loaded_at_query:
                        row = freshness.query_freshness(self.backend.spark, self._text(s.loaded_at_query), self.options.at).first()
                    else:
                        row = freshness.source_freshness(self.backend.sql(f"select * from {self.graph.relation(s)}"), self._text(s.loaded_at_field or ""), s.freshness.filter, self.options.at).first()
                except PySparkException as e:
                    results.append(FreshnessResult(s.unique_id, "runtime error", error=short(e)))
                    continue
                results.append(FreshnessResult(s.unique_id, freshness.status(row.age_seconds, s.freshness), row.max_loaded_at, row.snapshotted_at, row.age_seconds, s.freshness, s.freshness.filter))
        artifacts.write(self.folder, "sources.json", artifacts.sources(results))
        if any(r.status in ("error", "runtime error") for r in results):
            raise ResourceFailure("one or more source freshness checks failed", results)
        return results

    @staticmethod
    def _text(sql: str) -> str:
        from weftline.functions.dialect import to_spark, trim_terminator

        return to_spark(trim_terminator(sql))

    def docs_generate(self) -> int:
        found = [r for r in self.chosen() if r.kind == "model"]
        self.compile_resources(found)
        self.write_manifest()
        there = {}
        for r in self.graph.of("model", "seed", "source"):
            if columns := self.backend.columns(*relation_parts(self.graph, r)):
                there[r.unique_id] = columns
        artifacts.write(self.folder, "catalog.json", artifacts.catalog(self.graph, there))
        return len(found)

    # unit tests

    def _validate(self, u: UnitTest) -> None:
        for given in u.given:
            unit_tests.check_fixture(given, f"unit test {u.name}")
            self.fixture_input(u, given["input"])
        unit_tests.check_fixture(u.expect, f"unit test {u.name}", empty=True)

    def fixture_input(self, u: UnitTest, text: str) -> Resource:
        call = literal_call(text)
        if not call or call[0] == "source" and not call[1]:
            raise ProjectError(f"unit test {u.name}: an input must be a literal ref or source call, not {text!r}")
        kind, first, last = call
        found: Resource = find_ref(self.graph, first, last, u.package) if kind == "ref" else find_source(self.graph, first or "", last, u.package)
        if isinstance(found, Node) and found.materialized == "ephemeral":
            raise ProjectError(f"unit test {u.name}: the input {text} is ephemeral")
        if isinstance(found, Source) and (found.database or not all(found.quoting.values())):
            raise ProjectError(f"unit test {u.name}: the input {text} has a database or switched-off quoting")
        return found

    def unit_test_failures(self, u: UnitTest) -> int:
        """Differing rows; the model reads temporary views in place of its inputs."""
        spark, views = self.backend.spark, {}
        try:
            for given in u.given:
                name = f"weftline_fixture_{uuid.uuid4().hex}"
                unit_tests.literal_rows(spark, given["rows"]).createOrReplaceTempView(name)
                views[self.fixture_input(u, given["input"]).unique_id] = name
            model = next(self.graph.resources[k] for k in u.depends_on if k.startswith("model.") and self.graph.resources[k].name == u.model)
            assert isinstance(model, Node)
            actual = self.backend.sql(Compiler(self.graph, lambda r: views.get(r.unique_id)).model(model))
            expected = unit_tests.literal_rows(spark, u.expect["rows"]) if u.expect["rows"] else None
            return int(unit_tests.failures(actual, expected).first().failures)
        finally:
            for name in views.values():
                spark.catalog.dropTempView(name)


class _Run:
    """One execution.  Nodes run in waves of those that are ready; results are told in execution order."""

    def __init__(self, project: Project, order: list[Node], tests: list[Test], units: list[UnitTest], stop: bool):
        self.p, self.g, self.order, self.stop = project, project.graph, order, stop
        self.tests = {t.unique_id: t for t in tests}
        self.units = {u.unique_id: u for u in units}
        self.done: dict[str, Result] = {}
        self.blocked: set[str] = set()
        self.needs = {k: built_parents(self.g, k) for k in [*(n.unique_id for n in order), *self.tests]}
        self.chosen = {n.unique_id for n in order}

    def go(self) -> list[Result]:
        with ThreadPoolExecutor(max(1, self.p.options.threads)) as pool:
            self._tests(pool)
            left = list(self.order)
            while left:
                self._skip(left)
                left = [n for n in left if n.unique_id not in self.done]
                wave = [n for n in left if all(k in self.done for k in self.needs[n.unique_id] & self.chosen)]
                if self.stop:
                    wave = wave[:1]
                before = [u for n in wave for u in self.units.values() if n.unique_id in u.depends_on and u.model == n.name and u.unique_id not in self.done]
                for u, r in zip(before, pool.map(self._unit, before), strict=True):
                    self.done[u.unique_id] = r
                    if r.status in ("fail", "error"):
                        self.blocked |= {n.unique_id for n in wave if n.unique_id in u.depends_on and n.name == u.model}
                self._skip(wave)
                wave = [n for n in wave if n.unique_id not in self.done]
                for n, r in zip(wave, pool.map(self._node, wave), strict=True):
                    self.done[n.unique_id] = r
                    if r.status == "error":
                        self.blocked.add(n.unique_id)
                if self.stop and any(self.done[n.unique_id].status == "error" for n in wave):
                    left = [n for n in left if n.unique_id not in self.done]
                    self._skip(left)
                    break
                self._tests(pool)
                left = [n for n in left if n.unique_id not in self.done]
            for t in self.tests.values():
                if t.unique_id not in self.done and self.needs[t.unique_id] & self.blocked:
                    self.done[t.unique_id] = Result(t.unique_id, "skipped", compiled_code=t.compiled)
            self._tests(pool, rest=True)
            rest = [u for k, u in sorted(self.units.items()) if k not in self.done]
            for u, r in zip(rest, pool.map(self._unit, rest), strict=True):
                self.done[u.unique_id] = r
        return self._told()

    def _told(self) -> list[Result]:
        """Unit tests before their model, each node, then the tests that it was the last one for."""
        place = {n.unique_id: i for i, n in enumerate(self.order)}

        def key(k: str) -> tuple[int, int, str]:
            if k in place:
                return (place[k], 1, k)
            if k in self.units:
                return (min([place[x] for x in self.units[k].depends_on if x in place and self.g.resources[x].name == self.units[k].model], default=len(place)), 0, k)
            return (max([place[x] for x in self.needs[k] if x in place], default=-1), 2, k)

        return [self.done[k] for k in sorted(self.done, key=key)]

    def _skip(self, nodes: list[Node]) -> None:
        """Nodes that depend on blocked ones, or are blocked themselves, are skipped and block in turn."""
        again = True
        while again:
            again = False
            for n in nodes:
                if n.unique_id not in self.done and (n.unique_id in self.blocked or self.needs[n.unique_id] & self.blocked):
                    self.done[n.unique_id] = Result(n.unique_id, "skipped", relation_name=self.g.relation(n), compiled_code=n.compiled)
                    self.blocked.add(n.unique_id)
                    again = True

    def _node(self, n: Node) -> Result:
        schema, name = relation_parts(self.g, n)
        relation = self.g.relation(n)
        try:
            if n.kind == "seed":
                if not inside(n.file):
                    raise ProjectError(f"{n.file}: a seed must lie in its project")
                self.p.backend.seed(schema, name, Path(n.root) / n.file, n.column_types, n.quote_columns)
            else:
                self.p.backend.build(schema, name, n.compiled or "", n.materialized)
        except (PySparkException, ProjectError, OSError, ValueError) as e:
            return Result(n.unique_id, "error", short(e), compiled_code=n.compiled, relation_name=relation)
        return Result(n.unique_id, "success", compiled_code=n.compiled, relation_name=relation)

    def _tests(self, pool: ThreadPoolExecutor, rest: bool = False) -> None:
        """Run the tests that are ready: of what was selected, all must be done and nothing blocked."""
        ready = []
        for k, t in sorted(self.tests.items()):
            needs = self.needs[k]
            if k in self.done or needs & self.blocked or not all(x in self.done for x in needs & self.chosen):
                continue
            if rest or not self.chosen or needs & self.chosen:
                ready.append(t)
        fused = self._fused(ready)
        for t, r in zip(ready, pool.map(lambda t: self._test(t, fused.get(t.unique_id)), ready), strict=True):
            self.done[t.unique_id] = r
            if r.status in ("fail", "error"):
                self.blocked |= {t.attached} if t.attached else {k for k in t.depends_on if isinstance(self.g.resources[k], Node)}
        # what a failed test blocks stays done itself; only what depends on it is skipped

    def _fused(self, ready: list[Test]) -> dict[str, int]:
        """Failures of the plain not-null tests of one relation, counted in one pass."""
        groups: dict[str, list[Test]] = {}
        for t in ready:
            if is_built_in(t) and t.spec and t.spec.name == "not_null" and t.column and not t.config.where and t.config.limit is None and t.attached and self._direct(t.attached):
                groups.setdefault(t.attached, []).append(t)
        out = {}
        for k, tests in groups.items():
            if len(tests) > 1:
                try:
                    counts = checks.not_null_counts(self._rows(k), list(dict.fromkeys(t.column or "" for t in tests)))
                except PySparkException:
                    continue  # each tells its own error
                out |= {t.unique_id: counts[t.column or ""] for t in tests}
        return out

    def _direct(self, k: str) -> bool:
        r = self.g.resources[k]
        return not (isinstance(r, Node) and r.materialized == "ephemeral")

    def _rows(self, k: str) -> DataFrame:
        return self.p.backend.sql(f"select * from {self.g.relation(self.g.resources[k])}")

    def failing(self, t: Test) -> DataFrame:
        """The failing rows of a test."""
        if is_built_in(t) and t.spec and t.attached and t.column and self._direct(t.attached):
            df, where = self._rows(t.attached), t.config.where
            if t.spec.name == "not_null":
                found = checks.not_null(df, t.column, where)
            elif t.spec.name == "unique":
                found = checks.unique(df, t.column, where)
            elif t.spec.name == "accepted_values":
                found = checks.accepted_values(df, t.column, t.spec.values, t.spec.quote, where)
            else:
                parent = relationship_parent(self.g, t)
                if not self._direct(parent.unique_id):
                    return self.p.backend.sql(t.compiled or "")
                found = checks.relationships(df, t.column, self._rows(parent.unique_id), t.spec.field, where)
            return checks.limited(found, t.config.limit)
        return self.p.backend.sql(t.compiled or "")

    def _test(self, t: Test, known: int | None) -> Result:
        c = t.config
        try:
            n = known if known is not None and not (known and c.store_failures) else None
            if n is None:
                found = self.failing(t)
                if c.store_failures:  # written once, then counted where it is
                    self.p.backend.write(AUDIT, t.identifier, found)
                    found = self.p.backend.sql(f"select * from {tick(AUDIT)}.{tick(t.identifier)}")
                n = int(checks.failure_count(found).first().failures)
                if c.store_failures and not n:
                    self.p.backend.drop(AUDIT, t.identifier)
            elif c.store_failures:
                self.p.backend.drop(AUDIT, t.identifier)
            status, message = checks.status(n, c.severity, c.warn_if, c.error_if)
        except (PySparkException, ProjectError) as e:
            return Result(t.unique_id, "error", short(e), compiled_code=t.compiled)
        return Result(t.unique_id, status, message, n, t.compiled)

    def _unit(self, u: UnitTest) -> Result:
        try:
            n = self.p.unit_test_failures(u)
        except (PySparkException, ProjectError) as e:
            return Result(u.unique_id, "error", short(e))
        status, message = checks.status(n)
        return Result(u.unique_id, status, message, n)


def short(e: Exception) -> str:
    return str(e).split("\n\nJVM stacktrace")[0].strip()[:2000]


def clean(options: Options) -> list[str]:
    """Remove the clean-targets of a project; all are checked first."""
    project = load_project(options.project_dir)
    kept = {Path(p).parts[0] for k in ("model", "seed", "analysis", "test", "macro") for p in project.paths[k] if p}
    for t in project.clean_targets:
        if not t.strip() or Path(t).parts in ((), (".",)):
            raise ProjectError("clean-targets must be non-empty paths in the project")
        if not inside(t) or not (project.root / t).resolve().is_relative_to(project.root.resolve()):
            raise ProjectError(f"clean refuses paths outside the project: {t}")
        if Path(t).parts[0] in kept:
            raise ProjectError(f"clean refuses to remove source paths: {t}")
    gone = []
    for t in project.clean_targets:
        path = project.root / t
        if path.is_dir() and not path.is_symlink():
            shutil.rmtree(path)
            gone.append(t)
        elif path.exists() or path.is_symlink():
            path.unlink()
            gone.append(t)
    return gone


def summary(results: list[Any]) -> dict[str, int]:
    out: dict[str, int] = {}
    for r in results:
        out[r.status] = out.get(r.status, 0) + 1
    return out

