"""Commands, selection and artifacts of the engine, on small projects."""

import json

import pytest

from weftline import cli, queries
from weftline.errors import FAILURE, OK, USAGE, ProjectError, ResourceFailure
from weftline.plans.order import execution_order
from weftline.sources.backend import inferred

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tested(spark):
    return queries.tested_project(spark, SF)


def names(p, select=None, exclude=None, kind=None):
    return sorted(r.name for r in p.selector.select(select, exclude, kind))


def arguments(p, command, *more):
    return [*command.split(), "--project-dir", p.options.project_dir, *more]


# selection


def test_methods_of_the_selector(tested):
    every = ["named", "nation", "not_null_raw_nation_n_nationkey", "places", "unique_places_n_nationkey"]
    found = names(tested)
    assert {"named", "nation", "places", "unique_places_n_nationkey"} <= set(found) and len(found) == len(every)
    assert names(tested, exclude="places") == sorted(set(found) - {"places", "named", "unique_places_n_nationkey"})
    assert names(tested, "test_type:generic") == sorted(set(found) - {"places", "named", "nation"})
    assert names(tested, "resource_type:test", "named") == names(tested, "test_type:generic")
    assert names(tested, "source:raw") == names(tested, "source:raw.*") == ["nation"]
    assert names(tested, "source:raw+,resource_type:model") == ["places"]
    assert names(tested, "file:places.sql") == names(tested, "file:plac*") == ["places"]
    assert names(tested, "package:this") == names(tested, "package:shop") == found
    assert names(tested, "config.materialized:view") == ["places"] and names(tested, "config.materialized:table") == []
    assert names(tested, None, None, "source") == ["nation"]
    with pytest.raises(ProjectError):
        tested.selector.select("places,")
    with pytest.raises(ProjectError):
        tested.selector.select(None, None, "nothing")


def test_state_and_aliases(spark, tmp_path):
    alias = "selectors:\n  - name: both\n    definition:\n      union:\n        - a\n        - b+\n  - name: but\n    definition:\n      union:\n        - '*'\n        - exclude: [a]\n"
    p = queries.project(spark, SF, {"models/a.sql": "select 1 as x", "models/b.sql": "select 2 as x", "models/c.sql": "select x from {{ ref('b') }}", "selectors.yml": alias})
    for selector, want in (("both", ["a", "b", "c"]), ("but", ["b", "c"])):
        p.options.selector = selector
        assert sorted(r.name for r in p.chosen()) == want
    p.options.selector = None
    p.parse()
    more = queries.project(spark, SF, {"models/a.sql": "select 1 as x", "models/new.sql": "select 2 as x"}, state=str(p.folder))
    assert [r.name for r in more.selector.select("state:new")] == ["new"]


def test_models_are_ordered_by_their_refs(spark):
    p = queries.project(spark, SF, {"models/a.sql": "select x from {{ ref('z') }}", "models/z.sql": "select x from {{ ref('s') }}", "seeds/s.csv": "x\n1\n"})
    assert [r.name for r in execution_order(p.graph, p.graph.of("model", "seed"))] == ["s", "z", "a"]


# commands


@pytest.mark.parametrize("command, select", [("run", "source:raw.nation"), ("seed", "places"), ("compile", "source:raw.nation"), ("build", "source:raw.nation"), ("test", "resource_type:model")])
def test_a_selection_without_anything_to_do_is_refused(spark, tested, command, select, capsys):
    results = tested.folder / "run_results.json"
    results.unlink(missing_ok=True)
    assert cli.main(arguments(tested, command, "--select", select), lambda graph: spark) == USAGE
    assert "the selection holds no" in capsys.readouterr().err and not results.exists()


def test_with_seeds_tests_must_be_of_what_is_built(spark):
    files = {"seeds/s.csv": "x\n1\n", "models/m.sql": "select x from {{ ref('s') }}", "models/o.sql": "select 1 as x", "tests/t.sql": "select 1 from {{ ref('o') }} where x > 1"}
    p = queries.project(spark, SF, files, select="s m t")
    with pytest.raises(ProjectError, match="not selected"):
        p.build()
    assert not (p.folder / "run_results.json").exists()
    p.options.select = "s m o t"
    assert {r.status for r in p.build()} == {"success", "pass"}


def test_exit_codes_and_artifacts(spark, tested, capsys):
    run = lambda *x: cli.main(list(x), lambda graph: spark)
    assert run() == run("--help") == run("version") == run("run", "--help") == OK
    assert run("nonsense") == USAGE and run(*arguments(tested, "run", "--nonsense")) == USAGE
    assert run(*arguments(tested, "ls")) == OK and "places" in capsys.readouterr().out
    assert run(*arguments(tested, "build")) == OK
    found = {r["unique_id"]: r["status"] for r in json.loads((tested.folder / "run_results.json").read_text())["results"]}
    assert found["model.shop.places"] == "success" and sorted(found.values()) == ["pass"] * 3 + ["success"]
    assert run(*arguments(tested, "docs generate")) == OK
    manifest, catalog = (json.loads((tested.folder / f"{x}.json").read_text()) for x in ("manifest", "catalog"))
    assert {"metadata", "nodes", "sources", "macros", "parent_map", "child_map"} <= set(manifest)
    assert manifest["child_map"]["source.shop.raw.nation"] and "model.shop.places" in manifest["nodes"]
    assert [c["type"] for c in catalog["nodes"]["model.shop.places"]["columns"].values()] == ["INTEGER", "VARCHAR"]
    assert run(*arguments(tested, "clean")) == OK and not (tested.folder / "manifest.json").exists()


def test_failures_end_with_their_code(spark, capsys):
    files = {"models/m.sql": "select 1 as x union all select 1", "models/m.yml": "models:\n  - name: m\n    columns:\n      - name: x\n        tests: [{unique: {config: {store_failures: true}}}]\n", "models/n.sql": "select x from {{ ref('m') }}"}
    p = queries.project(spark, SF, files)
    assert cli.main(arguments(p, "build"), lambda graph: spark) == FAILURE
    found = {r["unique_id"].split(".")[2]: (r["status"], r["failures"]) for r in json.loads((p.folder / "run_results.json").read_text())["results"]}
    assert found["m"][0] == "success" and found["unique_m_x"] == ("fail", 1) and found["n"][0] == "skipped"
    with pytest.raises(ResourceFailure):
        p.test()


# seeds and macros


def test_integers_of_any_size_stay_whole():
    for values, kind in ((["1", "-2"], "bigint"), (["9223372036854775807", "-9223372036854775808"], "bigint"), (["9223372036854775808"], "decimal(38,0)"), (["1" * 39], "double"), (["1", "1.5"], "double"), ([None], "string"), (["1", "x"], "string")):
        assert inferred(values) == kind


def test_a_macro_of_another_adapter_is_not_taken(spark):
    macros = "{% macro f() %}{{ return(adapter.dispatch('f')()) }}{% endmacro %}\n{% macro duckdb__f() %}1{% endmacro %}\n{% macro default__f() %}2{% endmacro %}"
    p = queries.project(spark, SF, {"macros/f.sql": macros, "models/m.sql": "select {{ f() }} as x"})
    p.run()
    assert queries.relation(p, "m").first().x == 2
