"""Loading, templates, selection, artifacts and commands that need no data, on projects of a few files."""

import hashlib
import json
import threading
import urllib.error
import urllib.request
from datetime import datetime
from pathlib import Path

import pytest

from weftline import artifacts, cli, serve
from weftline.errors import FAILURE, OK, USAGE, ProjectError, ResourceFailure
from weftline.operators import checks, unit_tests
from weftline.runner import Options, Project
from weftline.sources.files import discover, inside


@pytest.fixture
def make(tmp_path):
    """Writes a project and loads it."""

    def made(files, session=None, **options):
        default = {} if (tmp_path / "dbt_project.yml").exists() else {"dbt_project.yml": "name: shop\n"}
        for name, text in (default | files).items():
            file = tmp_path / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
        return Project(Options(project_dir=str(tmp_path), **options), session)

    return made


def names(p, select=None, exclude=None, kind=None):
    return sorted(r.name for r in p.selector.select(select, exclude, kind))


def compiled(p, name="m"):
    return " ".join(p.compiler.model(p.graph.resources[f"model.shop.{name}"]).split())


def package(name, files):
    return {f"dbt_packages/{name}/{k}": v for k, v in ({"dbt_project.yml": f"name: {name}\n"} | files).items()}


# files


def test_files_are_found_in_order_without_hidden_and_built_ones(tmp_path):
    for f in ("m/b.sql", "m/a/z.sql", "m/.x.sql", "m/.git/y.sql", "m/target/t.sql", "m/dbt_packages/p.sql", "m/logs/l.sql", "m/a.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    assert discover(tmp_path, "m", (".sql",)) == ["m/a/z.sql", "m/b.sql"] and discover(tmp_path, "none", (".sql",)) == []


def test_seeds_stay_in_their_project():
    assert inside("seeds/a.csv") and not any(map(inside, ("", "/etc/passwd", "../a.csv", "seeds/../../a.csv")))


# project files


def test_paths_targets_and_variables_of_a_project(make):
    files = {"sql/m.sql": "select * from {{ ref(var('a')) }}, {{ ref(var('b')) }}, {{ ref(var('c', 'z')) }}", "more/n.sql": "select 1", "models/o.sql": "select 1"} | {f"sql/{x}.sql": "select 1" for x in "xyz"}
    p = make({"dbt_project.yml": 'name: shop\nmodel-paths: [sql, "more"]\ntarget-path: out\nvars:\n  a: x\n  b: two # not this\n'} | files, vars='{"b": "y"}')
    assert names(p, None, None, "model") == ["m", "n", "x", "y", "z"] and p.folder.name == "out"
    assert p.graph.resources["model.shop.m"].depends_on == ["model.shop.x", "model.shop.y", "model.shop.z"]
    assert make({}, vars="{b: y}").graph.vars == {"a": "x", "b": "y"}
    with pytest.raises(ProjectError):
        make({"sql/m.sql": "select * from {{ ref(var('nowhere')) }}"})


@pytest.mark.parametrize("text", ["", "name: ''\n", "name: shop\ndispatch:\n  - macro_namespace: a\n", "name: shop\nflags:\n  validate_macro_args: maybe\n", "name: [\n"])
def test_malformed_project_files_are_refused(make, text):
    with pytest.raises(ProjectError):
        make({"dbt_project.yml": text})


def test_profiles(make):
    outputs = "shop:\n  target: a\n  outputs:\n    a:\n      type: postgresql\n      schema: s\n    b:\n      type: duckdb\n      path: x.db\n    c:\n      schema: s\n"
    p = make({"dbt_project.yml": "name: shop\nprofile: shop\n", "profiles.yml": outputs, "models/m.sql": "select '{{ target.name }}' as n, '{{ target.schema }}' as s, '{{ target.type }}' as t, '{{ target.profile_name }}' as p, '{{ this.schema }}' as a, '{{ this.name }}' as b"})
    assert compiled(p) == "select 'a' as n, 's' as s, 'postgres' as t, 'shop' as p, 's' as a, 'm' as b"
    with pytest.raises(ProjectError, match="can be run"):
        p.run()
    b = make({}, target="b").graph.target
    assert b.schema == "main" and Path(b.path).name == "x.db" and Path(b.path).is_absolute()
    for wrong in ({"target": "c"}, {"target": "d"}, {"profile": "none"}):
        with pytest.raises(ProjectError):
            make({}, **wrong)


def test_path_configs_and_precedence(make):
    project = "name: shop\nmodels:\n  +tags: all\n  shop:\n    +materialized: table\n    deep:\n      +materialized: view\n      +tags: [low]\n      +docs:\n        show: false\nseeds:\n  shop:\n    +docs:\n      node_color: red\n"
    yml = "models:\n  - name: b\n    config: {materialized: table, tags: [yaml]}\n  - name: c\n    config: {materialized: table, enabled: false}\n  - name: gone\n    description: none\n"
    files = {"models/a.sql": "select 1", "models/deep/b.sql": "select 1", "models/deep/c.sql": "{{ config(materialized='ephemeral', enabled=true, tags=['inline']) }}select 1", "models/deep/d.sql": "select 1", "models/x.yml": yml, "seeds/s.csv": "x\n1\n"}
    p = make({"dbt_project.yml": project} | files)
    r = {n.name: n for n in p.graph.of("model", "seed", enabled=False)}
    assert {k: r[k].materialized for k in "abcd"} == {"a": "table", "b": "table", "c": "ephemeral", "d": "view"}
    assert r["b"].tags == ["all", "low", "yaml"] and r["c"].tags == ["all", "low", "inline"] and r["c"].enabled
    assert r["d"].docs["show"] is False and r["s"].docs["node_color"] == "red"
    assert any("gone" in w for w in p.graph.warnings)
    assert names(p, "config.materialized:table") == ["a", "b"]


def test_the_roots_settings_hold_over_those_of_packages(make):
    files = package("pack", {"models/m.sql": "{{ config(materialized='view') }}select 1", "macros/f.sql": "{% macro f() %}7{% endmacro %}"})
    p = make({"dbt_project.yml": "name: shop\nmodels:\n  pack:\n    +materialized: table\n", "models/n.sql": "select * from {{ ref('pack', 'm') }}", "models/o.sql": "select {{ pack.f() }} as x", "macros/g.sql": "{% macro g() %}{{ return(f()) }}{% endmacro %}"} | files)
    assert p.graph.resources["model.pack.m"].materialized == "table"
    assert p.graph.resources["model.shop.n"].depends_on == ["model.pack.m"]
    assert p.graph.macros["macro.shop.g"].depends_on == ["macro.pack.f"]  # macros find those of other packages
    assert compiled(p, "o") == "select 7 as x" and p.graph.resources["model.shop.o"].macros == ["macro.pack.f"]
    assert names(p, "package:pack") == ["m"] and names(p, "package:this") == ["n", "o"]


@pytest.mark.parametrize(
    "files",
    [
        {"models/a/m.sql": "select 1", "models/b/m.sql": "select 1"},
        {"seeds/a/m.csv": "x\n1\n", "seeds/b/m.csv": "x\n1\n"},
        {"analyses/a/m.sql": "select 1", "analyses/b/m.sql": "select 1"},
        {"tests/a/m.sql": "select 1", "tests/b/m.sql": "select 1"},
        {"macros/a.sql": "{% macro f() %}1{% endmacro %}", "macros/b.sql": "{% macro f() %}1{% endmacro %}"},
        {"models/a.md": "{% docs d %}x{% enddocs %}", "models/b.md": "{% docs d %}x{% enddocs %}"},
        {"models/a.yml": "exposures:\n  - name: e\n    type: dashboard\n    owner: {name: o}\n  - name: e\n    type: dashboard\n    owner: {name: o}\n"},
        {"macros/a.sql": "{% macro f() %}1{% endmacro %}", "macros/a.yml": "macros:\n  - name: f\n  - name: f\n"},
    ],
)
def test_names_are_unique(make, files):
    with pytest.raises(ProjectError, match="duplicate"):
        make(files)


# properties


def test_columns_descriptions_and_docs_blocks(make):
    yml = "models:\n  - name: m\n    description: '{{ doc(\"told\") }}'\n    columns:\n      - name: x\n        description: one\n        tests: [unique]\n      - name: x\n        tests: [not_null]\n"
    p = make({"models/m.sql": "select 1 as x", "models/m.yml": yml, "models/d.md": "{% docs told %}\n A text. \n{% enddocs %}"})
    m = p.graph.resources["model.shop.m"]
    assert m.description == "A text." and m.doc_blocks == ["doc.shop.told"]
    assert m.columns["x"].description == "one" and [t.name for t in m.columns["x"].tests] == ["unique", "not_null"]
    for text in ("{{ doc('none') }}", "see {{ doc('told') }}"):
        with pytest.raises(ProjectError):
            make({"models/m.yml": yml.replace("'{{ doc(\"told\") }}'", f'"{text}"')})


def test_sources_inherit_their_defaults(make):
    yml = """
sources:
  - name: raw
    schema: lake
    loaded_at_field: ts
    freshness: {warn_after: {count: 1, period: day}}
    tags: [src]
    tables:
      - name: a
      - name: b
        identifier: bee
        freshness: null
        tags: [tab]
      - name: c
        freshness: {error_after: {count: 2, period: hour}}
"""
    p = make({"models/s.yml": yml, "models/m.sql": "select * from {{ source('raw', 'b') }}"})
    a, b, c = (p.graph.resources[f"source.shop.raw.{x}"] for x in "abc")
    assert a.freshness.warn_after.count == 1 and a.loaded_at_field == "ts" and a.tags == ["src"]
    assert b.freshness is None and b.tags == ["src", "tab"]
    assert c.freshness.warn_after.count == 1 and c.freshness.error_after.period == "hour"
    assert compiled(p).replace("`", "").replace('"', "").endswith("lake.bee")
    assert names(p, "resource_type:source") == ["a", "b", "c"] and names(p, "+m", None, "source") == ["b"]
    with pytest.raises(ProjectError):
        make({"models/n.sql": "select * from {{ source('raw', 'none') }}"})


def test_exposures_depend_on_what_they_name(make):
    yml = "exposures:\n  - name: board\n    type: dashboard\n    owner: {name: Ada, email: a@example.org}\n    depends_on: [ref('m')]\n    tags: [seen]\n"
    p = make({"models/m.sql": "select 1 as x", "models/e.yml": yml})
    assert names(p, "exposure:board") == ["board"] and names(p, "+exposure:board") == ["board", "m"] and names(p, "exposure:b*") == ["board"]
    e = artifacts.manifest(p.graph)["exposures"]["exposure.shop.board"]
    assert e["depends_on"]["nodes"] == ["model.shop.m"] and e["owner"] == {"email": "a@example.org", "name": "Ada"} and e["type"] == "dashboard"
    with pytest.raises(ProjectError):
        make({"models/e.yml": yml.replace("ref('m')", "ref('none')")})


def test_singular_tests_take_properties(make):
    p = make({"models/m.sql": "select 1 as x", "tests/t.sql": "select * from {{ ref('m') }}", "tests/t.yml": "data_tests:\n  - name: t\n    description: told\n    config: {severity: warn, tags: [slow], limit: 3}\n"})
    t = p.graph.resources["test.shop.t"]
    assert (t.config.severity, t.config.limit, t.tags, t.description, t.depends_on) == ("warn", 3, ["slow"], "told", ["model.shop.m"])
    assert names(p, "tag:slow") == ["t"]


def test_macro_properties_warn_of_what_does_not_fit(make):
    yml = "macros:\n  - name: f\n    description: adds\n    arguments:\n      - {name: a, type: integer}\n      - {name: c, type: 'list[odd]'}\n  - name: none\n"
    files = {"macros/f.sql": "{% macro f(a, b=1) %}{{ a }}{% endmacro %}", "macros/f.yml": yml}
    p = make({"dbt_project.yml": "name: shop\nflags:\n  validate_macro_args: true\n"} | files)
    assert p.graph.macros["macro.shop.f"].description == "adds"
    assert len(p.graph.warnings) == 3 and not [w for w in p.graph.warnings if "integer" in w]
    assert len(make({"dbt_project.yml": "name: shop\n"} | files).graph.warnings) == 1


# templates


def test_macros_call_macros_and_dispatch(make):
    macros = "{% macro a(x) %}{{ return(b(x)) }}{% endmacro %}\n{% macro b(x) %}{{ return(adapter.dispatch(macro_name='c', macro_namespace='shop')(x)) }}{% endmacro %}\n{% macro default__c(x) %}({{ x }} + 1){% endmacro %}\n{% materialization own, adapter='spark', supported_languages=['sql', 'python'] %}{% endmaterialization %}"
    p = make({"macros/f.sql": macros, "models/m.sql": "select {{ a('2') }} as x"})
    assert compiled(p) == "select (2 + 1) as x"
    assert p.graph.macros["macro.shop.a"].depends_on == ["macro.shop.b"] and "macro.shop.default__c" in p.graph.macros["macro.shop.b"].depends_on
    assert p.graph.macros["macro.shop.materialization_own_spark"].languages == ["sql", "python"]
    with pytest.raises(ProjectError):
        make({"macros/g.sql": "{% materialization odd, supported_languages=['perl'] %}{% endmaterialization %}"})


@pytest.mark.parametrize("call", ["adapter.dispatch('a.c')('1')", "adapter.dispatch('c', packages=['p'])('1')"])
def test_unsupported_dispatches_are_refused(make, call):
    with pytest.raises(ProjectError):
        compiled(make({"macros/f.sql": "{% macro f() %}{{ return(" + call + ") }}{% endmacro %}\n{% macro default__c(x) %}1{% endmacro %}", "models/m.sql": "select {{ f() }}"}))


@pytest.mark.parametrize("body", ["{{ ref('n') }}", "{{ source('a', 'b') }}", "{{ this.name }}", "{{ target.name }}"])
def test_macros_know_their_arguments_only(make, body):
    with pytest.raises(ProjectError):
        compiled(make({"macros/f.sql": "{% macro f() %}" + body + "{% endmacro %}", "models/m.sql": "select {{ f() }}", "models/n.sql": "select 1"}))


def test_every_branch_counts_for_the_graph(make):
    p = make({"models/a.sql": "select 1 as x", "models/b.sql": "select 2 as x", "models/m.sql": "select * from {% if execute %}{{ ref('a') }}{% else %}{{ ref('b') }}{% endif %}"})
    assert p.graph.resources["model.shop.m"].depends_on == ["model.shop.a", "model.shop.b"]
    assert "b" not in compiled(p).replace("`", "").split(".")[-1]


def test_cycles_and_unknown_parents_are_refused(make):
    with pytest.raises(ProjectError):
        make({"models/m.sql": "select * from {{ ref('nowhere') }}"})
    p = make({"models/m.sql": "select * from {{ ref('n') }}", "models/n.sql": "select * from {{ ref('m') }}"}, lambda graph: None)
    with pytest.raises(ProjectError, match="(?i)cycl"):
        p.run()


# tests of projects

TESTED = """
models:
  - name: m
    config: {tags: [core]}
    tests:
      - unique: {column_name: x}
    columns:
      - name: x
        tests:
          - not_null
          - not_null
          - accepted_values: {values: [1, 2], quote: false}
          - relationships: {to: ref('n'), field: x}
"""


def test_generic_tests_of_tables_and_columns(make):
    p = make({"models/m.sql": "select 1 as x", "models/n.sql": "select 1 as x", "models/m.yml": TESTED})
    found = {t.spec.name: t for t in p.graph.of("test")}
    assert sorted(found) == ["accepted_values", "not_null", "relationships", "unique"] and len(p.graph.of("test")) == 4
    assert {t.column for t in found.values()} == {"x"} and {t.attached for t in found.values()} == {"model.shop.m"}
    assert found["relationships"].depends_on == ["model.shop.m", "model.shop.n"] and found["relationships"].refs == [(None, "m"), (None, "n")]
    assert len(names(p, "tag:core", None, "test")) == 4 and len(names(p, "n", None, "test")) == 0
    for t in found.values():
        assert "main" in p.compiler.test(t) and t.unique_id.startswith(f"test.shop.{t.name}.")


@pytest.mark.parametrize("head", ["t(model)", "t(column_name, model)", "t(model, column_name, more)"])
def test_custom_tests_take_a_model_and_a_column(make, head):
    files = {"models/m.sql": "select 1 as x", "models/m.yml": "models:\n  - name: m\n    columns:\n      - name: x\n        tests: [t]\n"}
    p = make(files | {"tests/generic/t.sql": "{% test " + head + " %}select * from {{ model }}{% endtest %}"})
    with pytest.raises(ProjectError):
        p.compiler.test(p.graph.of("test")[0])


def test_messages_of_thresholds():
    assert checks.status(1, "error", "!= 0", "!= 0")[1] == "Got 1 result, configured to fail if != 0"
    assert checks.status(12, "error", "!= 0", "> 20") == ("warn", "Got 12 results, configured to warn if != 0")
    assert checks.status(0)[0] == "pass"


UNIT = "unit_tests:\n  - name: u\n    model: m\n    given:\n      - input: {input}\n        rows: {rows}\n    expect: {{rows: {expect}}}\n"


def unit(make, given="ref('n')", rows="[{x: 1}]", expect="[{x: 1}]", more=None):
    return make({"models/m.sql": "select x from {{ ref('n') }}", "models/n.sql": "select 1 as x", "models/u.yml": UNIT.format(input=given, rows=rows, expect=expect)} | (more or {}), lambda graph: None)


def test_unit_tests_are_found_and_checked(make):
    p = unit(make, expect="[]")
    assert names(p, "unit_test:u") == names(p, "unit_test:m.u") == names(p, "test_type:unit") == ["u"]
    u = p.graph.of("unit_test")[0]
    p._validate(u)
    assert u.depends_on[0] == "model.shop.m" and p.fixture_input(u, "ref('n')").name == "n"


@pytest.mark.parametrize(
    "wrong",
    [
        {"given": "ref(x)"}, {"given": "source('n')"}, {"given": "ref('none')"}, {"rows": "[]"}, {"rows": "[{x: 1}, {y: 1}]"}, {"rows": "[{x: 1, y: 2}, {y: 1, x: 2}]"}, {"rows": "[{'': 1}]"},
        {"more": {"models/n.sql": "{{ config(materialized='ephemeral') }}select 1 as x"}},
        {"given": "source('s', 't')", "more": {"models/s.yml": "sources:\n  - name: s\n    database: d\n    tables: [{name: t}]\n"}},
        {"given": "source('s', 't')", "more": {"models/s.yml": "sources:\n  - name: s\n    quoting: {schema: false}\n    tables: [{name: t}]\n"}},
    ],
)
def test_fixtures_that_cannot_be_used_are_refused(make, wrong):
    with pytest.raises(ProjectError):
        unit(make, **wrong).test()


def test_rows_given_as_other_formats_are_refused():
    with pytest.raises(ProjectError):
        unit_tests.check_fixture({"rows": "x\n1\n", "format": "csv"}, "u")


# selection


def chain(make, **options):
    return make({"models/stage/a.sql": "{{ config(tags=['one']) }}select 1 as x", "models/stage/b.sql": "select * from {{ ref('a') }}", "models/mart/c.sql": "select * from {{ ref('b') }}", "models/mart/d.sql": "select 1 as x", "models/mart/d.yml": "models:\n  - name: d\n    description: x\n", "seeds/s.csv": "x\n1\n"}, **options)


@pytest.mark.parametrize(
    "select, exclude, want",
    [
        ("path:models/stage", None, "a b"), ("path:stage", None, "a b"), ("path:models/*/c.sql", None, "c"), ("path:models/*", None, "a b c d"), ("path:mart/d.yml", None, "d"),
        ("file:a", None, "a"), ("file:a.sql", None, "a"), ("file:[ab].sql", None, "a b"), ("shop.stage", None, "a b"), ("stage", None, "a b"), ("fqn:shop.mart.c", None, "c"), ("model.shop.c", None, "c"),
        ("+c", "b", "a c"), ("1+c", None, "b c"), ("a+1", None, "a b"), ("@b", None, "a b c"), ("tag:one+ d", "c", "a b d"), ("path:mart,c+", None, "c"), ("*", "path:models", "s"), ("[!a-c]", None, "d s"),
        ("resource_type:seed", None, "s"), ("tag:o?e", None, "a"), (None, "stage mart", "s"),
    ],
)
def test_selectors(make, select, exclude, want):
    assert names(chain(make), select, exclude) == want.split()


@pytest.mark.parametrize("text", ["a,", ",a", "tag:", "what:a", "resource_type:x", "test_type:x", "state:old", "result:odd", "source_status:odd", "+@a", "@a+", "a+b", "++a"])
def test_malformed_selectors_are_refused(make, text):
    with pytest.raises(ProjectError):
        chain(make).selector.select(text)


def test_results_and_freshness_of_earlier_runs(make, tmp_path):
    state = tmp_path / "state"
    state.mkdir()
    metadata = lambda x: {"dbt_schema_version": f"https://schemas.getdbt.com/dbt/{x}.json"}
    (state / "run_results.json").write_text(json.dumps({"metadata": metadata("run-results/v6"), "results": [{"unique_id": "model.shop.a", "status": "error"}, {"unique_id": "model.shop.b", "status": "skipped"}]}))
    (state / "sources.json").write_text(json.dumps({"metadata": metadata("sources/v3"), "results": [{"unique_id": "source.shop.r.t", "status": "warn"}]}))
    make({"models/s.yml": "sources:\n  - name: r\n    tables: [{name: t}, {name: u}]\n"})
    p = chain(make, state=str(state))
    assert names(p, "result:error") == ["a"] and names(p, "result:error+") == ["a", "b", "c"] and names(p, "result:skipped") == ["b"]
    assert names(p, "source_status:warn") == ["t"] and names(p, "source_status:error") == []
    with pytest.raises(ProjectError):
        names(p, "state:new")  # no manifest there
    (state / "run_results.json").write_text(json.dumps({"metadata": metadata("run-results/v5"), "results": []}))
    for wrong in (chain(make, state=str(state)), chain(make)):
        with pytest.raises(ProjectError):
            names(wrong, "result:error")


ALIASES = """
selectors:
  - name: text
    definition: 'tag:one c'
  - name: cut
    definition:
      intersection:
        - method: path
          value: models
        - {union: [{method: name, value: b, children: true, children_depth: 1}, 'd']}
        - exclude: [{method: file, value: d}]
  - name: parents
    definition: {method: fqn, value: c, parents: true, parents_depth: 1}
  - name: nested
    definition: {method: selector, value: cut, exclude: [c]}
  - name: round
    definition: {method: selector, value: round}
  - name: odd
    definition: {method: wrong, value: x}
"""


def test_selector_files(make):
    p = chain(make)
    (Path(p.options.project_dir) / "selectors.yml").write_text(ALIASES)
    for selector, want in (("text", "a c"), ("cut", "b c"), ("parents", "b c"), ("nested", "b"), ("text nested", "a b c")):
        p.options.selector = selector
        assert sorted(r.name for r in p.chosen()) == want.split()
    p.options.select, p.options.exclude = "d", "a"
    assert sorted(r.name for r in p.chosen()) == ["b", "c", "d"]
    for selector in ("none", "round", "odd"):
        p.options.selector = selector
        with pytest.raises(ProjectError):
            p.chosen()


def test_listings(make):
    p = chain(make, select="a")
    assert p.list() == ["model.shop.a"]
    for output, want in (("name", "a"), ("path", "models/stage/a.sql"), ("selector", "shop.stage.a")):
        p.options.output = output
        assert p.list() == [want]
    p.options.output, p.options.output_keys = "json", ["name", "tags", "fqn", "nonsense"]
    assert json.loads(p.list()[0]) == {"name": "a", "tags": ["one"], "fqn": ["shop", "stage", "a"]}


# artifacts


def test_manifests(make):
    p = make({"models/m.sql": "select 1 as x\n\n", "models/off.sql": "{{ config(enabled=false) }}select 1", "models/n.sql": "{{ config(materialized='table') }}select * from {{ ref('m') }}", "models/m.yml": TESTED, "analyses/q.sql": "select * from {{ ref('m') }}", "models/d.md": "{% docs d %}é{% enddocs %}", "macros/f.sql": "{% macro f(a) %}{{ a }}{% endmacro %}"})
    assert p.parse() == {"model": 2, "analysis": 1, "seed": 0, "source": 0, "exposure": 0, "unit_test": 0}
    first = (p.folder / "manifest.json").read_bytes()
    p.parse()
    assert (p.folder / "manifest.json").read_bytes() == first and "é".encode() in first
    m = json.loads(first)
    assert m["metadata"]["dbt_schema_version"].endswith("/manifest/v12.json") and m["metadata"]["project_name"] == "shop"
    assert m["nodes"]["model.shop.m"]["checksum"] == {"name": "sha256", "checksum": hashlib.sha256(b"select 1 as x").hexdigest()}
    assert list(m["disabled"]) == ["model.shop.off"] and "model.shop.off" not in m["nodes"]
    assert m["parent_map"]["model.shop.n"] == ["model.shop.m"] and "model.shop.n" in m["child_map"]["model.shop.m"] and "analysis.shop.q" in m["child_map"]["model.shop.m"]
    assert m["docs"]["doc.shop.d"]["block_contents"] == "é" and m["macros"]["macro.shop.f"]["macro_sql"].startswith("{% macro f(a)")
    tests = [n for n in m["nodes"].values() if n["resource_type"] == "test"]
    assert {t["test_metadata"]["name"] for t in tests} == {"unique", "not_null", "accepted_values", "relationships"} and all(t["column_name"] == "x" and t["attached_node"] == "model.shop.m" for t in tests)
    assert all(set(m["parent_map"][k]) <= set(m["child_map"]) for k in m["parent_map"])


def test_compiled_files(make):
    p = make({"models/a/e.sql": "{{ config(materialized='ephemeral') }}select 1 as x", "models/m.sql": "select * from {{ ref('e') }}", "analyses/q.sql": "select * from {{ ref('m') }}", "tests/t.sql": "select * from {{ ref('m') }};", "models/m.yml": "models:\n  - name: m\n    columns:\n      - name: x\n        tests: [unique]\n"})
    assert p.compile() == {"model": 2, "analysis": 1, "test": 2}
    base = p.folder / "compiled" / "shop"
    found = sorted(f.relative_to(base).as_posix() for f in base.rglob("*.sql"))
    assert found == ["analyses/q.sql", "models/a/e.sql", "models/m.sql", "models/m.yml/unique_m_x.sql", "tests/t.sql"]
    assert "__dbt__cte__e" in (base / "models/m.sql").read_text() and "with" not in (base / "analyses/q.sql").read_text().lower()
    m = json.loads((p.folder / "manifest.json").read_text())["nodes"]["model.shop.m"]
    assert m["compiled"] and m["extra_ctes"][0]["id"] == "model.shop.e" and m["compiled_path"].endswith("compiled/shop/models/m.sql")


def test_results_and_catalogs_have_their_fields(make):
    p = make({"models/m.sql": "select 1 as x", "models/s.yml": "sources:\n  - name: r\n    schema: lake\n    tables: [{name: t}]\n"})
    r = artifacts.run_results([artifacts.Result("model.shop.m", "success", compiled_code="select 1", relation_name="m"), artifacts.Result("test.shop.t", "fail", "Got 2 results", 2)])
    assert r["metadata"]["dbt_schema_version"].endswith("/run-results/v6.json") and [x["status"] for x in r["results"]] == ["success", "fail"]
    assert r["results"][0]["failures"] is None and r["results"][1] | {"failures": 2, "thread_id": "main", "execution_time": 0.0} == r["results"][1]
    c = artifacts.catalog(p.graph, {"model.shop.m": [("x", "INTEGER"), ("y", "VARCHAR")], "source.shop.r.t": [("z", "DOUBLE")]})
    assert c["metadata"]["dbt_schema_version"].endswith("/catalog/v1.json") and [v["index"] for v in c["nodes"]["model.shop.m"]["columns"].values()] == [1, 2]
    assert c["nodes"]["model.shop.m"]["metadata"]["type"] == "VIEW" and c["sources"]["source.shop.r.t"]["metadata"]["schema"] == "lake"
    s = artifacts.sources([artifacts.FreshnessResult("source.shop.r.t", "runtime error", error="none")])
    assert s["metadata"]["dbt_schema_version"].endswith("/sources/v3.json") and s["results"] == [{"unique_id": "source.shop.r.t", "error": "none", "status": "runtime error"}]


# commands


def test_options(make):
    o, more = cli.options("run", ["--select", "a", "b", "--exclude=c", "--threads", "4", "--vars={a: 1}", "--full-refresh", "-s", "d"])
    assert (o.select, o.exclude, o.threads, o.vars) == ("a b d", "c", 4, "{a: 1}")
    for command, args in (("run", ["--threads", "0"]), ("run", ["--select"]), ("run", ["--output", "json"]), ("ls", ["--output", "xml"]), ("ls", ["--resource-type", "x"]), ("ls", ["--target-path", "x"]), ("parse", ["--profile"]), ("run", ["a"]), ("run", ["--select", "a,"])):
        with pytest.raises(ProjectError):
            cli.options(command, args)


def test_clean_refuses_what_is_not_built(make, tmp_path, capsys):
    make({"models/m.sql": "select 1", "target/x.json": "{}", "dbt_project.yml": "name: shop\nclean-targets: [target, none]\n"})
    assert cli.main(["clean", "--project-dir", str(tmp_path)]) == OK and not (tmp_path / "target").exists() and "Removed target" in capsys.readouterr().out
    for target in ("/tmp", "../x", "models", "models/a", "."):
        make({"dbt_project.yml": f"name: shop\nclean-targets: [target, '{target}']\n", "target/x.json": "{}"})
        assert cli.main(["clean", "--project-dir", str(tmp_path)]) == USAGE and (tmp_path / "target").exists() and (tmp_path / "models/m.sql").exists()


def test_warnings_are_told_and_do_no_harm(make, tmp_path, capsys):
    make({"models/m.yml": "models:\n  - name: none\n"})
    assert cli.main(["parse", "--project-dir", str(tmp_path)]) == OK and "warning: " in capsys.readouterr().err
    assert cli.main(["docs", "serve", "--browser", "--project-dir", str(tmp_path)]) == USAGE


def test_docs_are_served_from_their_folder_only(tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/index.html").write_text("<p>it</p>")
    (tmp_path / "secret").write_text("x")
    (tmp_path / "docs/out").symlink_to(tmp_path / "secret")
    with serve.server(tmp_path / "docs", port=0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{s.server_address[1]}"
        assert urllib.request.urlopen(f"{base}/").read() == b"<p>it</p>"
        assert urllib.request.urlopen(urllib.request.Request(f"{base}/index.html", method="HEAD")).read() == b""
        for path, code in (("/..%2fsecret", 403), ("/out", 403), ("/sub/", 404), ("/none", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(base + path)
            assert e.value.code == code
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"{base}/", data=b"x", method="POST"))
        assert e.value.code == 501
        s.shutdown()


# commands with data


def test_freshness_goes_on_after_an_error(spark, make, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS fresh_lake")
    spark.sql("CREATE OR REPLACE VIEW fresh_lake.t AS SELECT timestamp_ntz'2024-01-02 00:00:00' AS ts")
    yml = """
sources:
  - name: lake
    schema: fresh_lake
    freshness: {warn_after: {count: 1, period: hour}, error_after: {count: 3, period: day}}
    tables:
      - {name: gone, loaded_at_field: ts}
      - {name: t, loaded_at_field: ts}
      - {name: unset}
"""
    p = make({"models/s.yml": yml}, lambda graph: spark, at=datetime(2024, 1, 3))
    with pytest.raises(ResourceFailure) as e:
        p.source_freshness()
    assert [r.status for r in e.value.results] == ["runtime error", "warn", "runtime error"]
    found = json.loads((p.folder / "sources.json").read_text())["results"]
    assert set(found[0]) == {"unique_id", "error", "status"} and found[1]["max_loaded_at_time_ago_in_s"] == 86400.0
    make({})
    assert cli.main(["source", "freshness", "--project-dir", str(tmp_path), "--select", "source:lake.gone"], lambda graph: spark) == FAILURE


def test_seeding_stops_at_the_first_failure(spark, make):
    p = make({"dbt_project.yml": "name: shop\nprofile: shop\n", "profiles.yml": "shop:\n  target: d\n  outputs:\n    d: {type: spark, schema: seeding}\n", "seeds/a.csv": "x\n1\n", "seeds/b.csv": "x,y\n1\n", "seeds/c.csv": "x\n1\n"}, lambda graph: spark)
    with pytest.raises(ResourceFailure) as e:
        p.seed()
    assert [(r.unique_id, r.status) for r in e.value.results] == [("seed.shop.a", "success"), ("seed.shop.b", "error")]
    assert not p.backend.kind("seeding", "c")


def test_other_materializations_are_refused_before_anything_is_built(spark, make):
    p = make({"models/a.sql": "select 1 as x", "models/m.sql": "{{ config(materialized='incremental') }}select 1 as x"}, lambda graph: spark)
    with pytest.raises(ProjectError, match="incremental"):
        p.run()
    assert not p.folder.exists()


def test_docs_tell_of_relations_that_exist(spark, make):
    files = {"dbt_project.yml": "name: shop\nprofile: shop\n", "profiles.yml": "shop:\n  target: d\n  outputs:\n    d: {type: spark, schema: documented}\n", "models/a.sql": "select 1 as x, 'y' as y", "models/b.sql": "select 1 as x"}
    p = make(files, lambda graph: spark, select="a")
    p.run()
    make({}, lambda graph: spark).docs_generate()
    c = json.loads((p.folder / "catalog.json").read_text())
    assert list(c["nodes"]) == ["model.shop.a"] and {k: (v["type"], v["index"]) for k, v in c["nodes"]["model.shop.a"]["columns"].items()} == {"x": ("INTEGER", 1), "y": ("VARCHAR", 2)}
