"""YAML property files: models, seeds, analyses, sources, exposures, unit tests, tests and macros."""

from __future__ import annotations

import re
from typing import Any

from weftline.config import flag, mapping, names
from weftline.errors import ProjectError
from weftline.model import Column, Exposure, Freshness, Source, TestConfig, TestSpec, Threshold, UnitTest
from weftline.naming import BUILT_IN

PERIODS = ("minute", "hour", "day")
_TEST_CONFIG = {"where", "limit", "severity", "warn_if", "error_if", "store_failures", "enabled", "tags"}
_CALL = re.compile(r"""\s*(ref|source)\(\s*(['"])([^'"]+)\2\s*(?:,\s*(['"])([^'"]+)\4\s*)?\)\s*""")


def entries(raw: Any, where: str) -> list[dict[str, Any]]:
    if raw in (None, ""):
        return []
    if not isinstance(raw, list) or not all(isinstance(x, dict) for x in raw):
        raise ProjectError(f"{where} must be a list of mappings")
    return raw


def named(entry: dict[str, Any], where: str) -> str:
    name = entry.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ProjectError(f"{where}: an entry has no name")
    return name.strip()


def literal_call(text: str) -> tuple[str, str | None, str] | None:
    """(ref or source, first of two arguments or None, last argument) of a literal call."""
    m = _CALL.fullmatch(text)
    return (m[1], m[3] if m[5] else None, m[5] or m[3]) if m else None


def test_config(raw: dict[str, Any], where: str, base: TestConfig | None = None, strict: bool = False) -> TestConfig:
    found = base or TestConfig()
    if strict and set(raw) - _TEST_CONFIG:
        raise ProjectError(f"{where}: unsupported test config {sorted(set(raw) - _TEST_CONFIG)}")
    for key in ("where", "warn_if", "error_if"):
        if raw.get(key):
            setattr(found, key, str(raw[key]))
    if raw.get("severity"):
        found.severity = str(raw["severity"])
        if strict and found.severity.lower() not in ("warn", "error"):
            raise ProjectError(f"{where}: severity must be warn or error")
    if raw.get("limit"):
        if not str(raw["limit"]).isdigit():
            raise ProjectError(f"{where}: limit must be an integer")
        found.limit = int(raw["limit"])
    for key in ("store_failures", "enabled"):
        if raw.get(key) is not None:
            setattr(found, key, flag(raw[key], key))
    found.tags = found.tags + names(raw.get("tags"), "tags")
    return found


def test_specs(raw: Any, where: str) -> list[TestSpec]:
    """The tests of a table or a column."""
    found = []
    for item in raw or []:
        if isinstance(item, str):
            item = {item: {}}
        if not isinstance(item, dict):
            raise ProjectError(f"{where}: a test must be a name or a mapping")
        given = dict(item)
        config: dict[str, Any] = {}
        if "test_name" in given:
            name = given.pop("test_name")
            given.pop("name", None)
        elif len(given) == 1 or isinstance(next(iter(given.values())), dict):
            name, own = next(iter(given.items()))
            given = {k: v for k, v in given.items() if k != name} | mapping(own, f"{where}: {name}")
        else:
            name = next(k for k, v in given.items() if not v)
            given.pop(name)
        if "config" in given:
            if isinstance(given["config"], str) and given["config"]:
                raise ProjectError(f"{where}: config must be a mapping")
            config = mapping(given.pop("config"), "config")
        if "arguments" in given:
            if isinstance(given["arguments"], str) and given["arguments"]:
                raise ProjectError(f"{where}: arguments must be a mapping")
            given |= mapping(given.pop("arguments"), "arguments")
        space, _, short = name.rpartition(".")
        if space in ("dbt", "weftline") and short not in BUILT_IN:
            raise ProjectError(f"{where}: {name} is not a built-in test")
        spec = TestSpec(short, space or None)
        spec.config = test_config({k: given[k] for k in _TEST_CONFIG & set(given)} | config, f"{where}: {name}")
        spec.values = names(given.get("values"), "values")
        spec.quote = flag(given["quote"], "quote") if given.get("quote") is not None else None
        spec.column = given.get("column_name") or None
        spec.to, spec.field = given.get("to") or "", given.get("field") or ""
        found.append(spec)
    return found


def columns(raw: Any, where: str) -> dict[str, Column]:
    found: dict[str, Column] = {}
    for entry in entries(raw, f"{where}: columns"):
        name = named(entry, where)
        column = found.setdefault(name, Column(name))
        column.description = entry.get("description") or column.description
        column.tags += names(entry.get("tags"), "tags")
        column.tests += test_specs(entry.get("tests"), f"{where}.{name}") + test_specs(entry.get("data_tests"), f"{where}.{name}")
    return found


def freshness(raw: Any, base: Freshness | None, where: str) -> Freshness | None:
    """A freshness block over that of the level above; ``null`` switches it off."""
    if isinstance(raw, str):
        if raw.strip().lower() in ("null", "~", ""):
            return None
        raise ProjectError(f"{where}: freshness must be a mapping")
    found = Freshness(base.warn_after, base.error_after, base.filter) if base else Freshness()
    for key in ("warn_after", "error_after"):
        if key in raw:
            if isinstance(raw[key], str):
                if raw[key].strip().lower() not in ("null", "~", ""):
                    raise ProjectError(f"{where}: {key} must be a mapping")
                setattr(found, key, None)
                continue
            limit = Threshold()
            if raw[key].get("count"):
                if not str(raw[key]["count"]).isdigit():
                    raise ProjectError(f"{where}: count must be an integer")
                limit.count = int(raw[key]["count"])
            limit.period = raw[key].get("period") or None
            if limit.period not in (None, *PERIODS):
                raise ProjectError(f"{where}: period must be one of {', '.join(PERIODS)}")
            setattr(found, key, limit)
    if raw.get("filter"):
        found.filter = raw["filter"]
    return found


def apply_source_level(source: Source, level: dict[str, Any], where: str, table: bool = False) -> None:
    """Settings of one level: what is set there wins over the levels before."""
    level = {k: v for k, v in level.items() if k != "config"} | mapping(level.get("config"), "config")
    if level.get("loaded_at_field") and level.get("loaded_at_query"):
        raise ProjectError(f"{where}: only one of loaded_at_field and loaded_at_query can be set")
    if level.get("loaded_at_field"):
        source.loaded_at_field, source.loaded_at_query = level["loaded_at_field"], None
    if level.get("loaded_at_query"):
        source.loaded_at_field, source.loaded_at_query = None, level["loaded_at_query"]
    if "freshness" in level:
        source.freshness = freshness(level["freshness"], source.freshness, where)
    if level.get("database"):
        source.database = level["database"]
    if level.get("schema") and not table:
        source.schema = level["schema"]
    if level.get("identifier"):
        source.identifier = level["identifier"]
    for part, on in mapping(level.get("quoting"), "quoting").items():
        if part not in ("database", "schema", "identifier"):
            raise ProjectError(f"{where}: unsupported quoting {part}")
        source.quoting[part] = flag(on, f"quoting {part}")


def plus(tree: Any) -> dict[str, Any]:
    return {k[1:]: v for k, v in tree.items() if k.startswith("+")} if isinstance(tree, dict) else {}


def read_sources(raw: Any, package: str, file: str, path: str, tree: dict[str, Any], schema: str) -> list[Source]:
    """Tables of the sources; levels from weak to strong: project (package, source), source, project (table), table."""
    found = []
    for entry in entries(raw, "sources"):
        name = named(entry, "sources")
        own = tree.get(package) if isinstance(tree.get(package), dict) else {}
        of_source = own.get(name) if isinstance(own.get(name), dict) else {}
        for table in entries(entry.get("tables"), f"source {name}"):
            where = f"source {name}.{named(table, name)}"
            source = Source("source", package, named(table, name), f"source.{package}.{name}.{named(table, name)}", path=path, file=file, source_name=name)
            apply_source_level(source, plus(tree), where)
            apply_source_level(source, plus(own), where)
            apply_source_level(source, plus(of_source), where)
            apply_source_level(source, {k: v for k, v in entry.items() if k != "identifier"}, where)
            apply_source_level(source, plus(of_source.get(table["name"])), where)
            apply_source_level(source, table, where, table=True)
            source.description, source.source_description = table.get("description") or "", entry.get("description") or ""
            source.tags = names(entry.get("tags"), "tags") + names(table.get("tags"), "tags")
            source.columns = columns(table.get("columns"), where)
            source.tests = test_specs(table.get("tests"), where) + test_specs(table.get("data_tests"), where)
            if source.schema and ("{{" in source.schema or "{%" in source.schema):
                filled = source.schema.replace("{{ target.schema }}", schema)
                if "{{" in filled or "{%" in filled:
                    raise ProjectError(f"{where}: unsupported template in schema")
                source.schema = filled
            found.append(source)
    return found


def read_exposures(raw: Any, package: str, file: str, path: str) -> list[Exposure]:
    found = []
    for entry in entries(raw, "exposures"):
        name = named(entry, "exposures")
        config = mapping(entry.get("config"), "config")
        out = Exposure("exposure", package, name, f"exposure.{package}.{name}", path=path, file=file, description=entry.get("description") or "")
        out.type, out.maturity, out.url = entry.get("type") or "", entry.get("maturity"), entry.get("url")
        out.owner = {k: v for k, v in mapping(entry.get("owner"), "owner").items() if k in ("name", "email")}
        out.tags = names(entry.get("tags"), "tags") + names(config.get("tags"), "tags")
        out.meta = mapping(entry.get("meta"), "meta") | mapping(config.get("meta"), "meta")
        out.enabled = flag(config["enabled"], "enabled") if "enabled" in config else True
        for item in names(entry.get("depends_on"), "depends_on"):
            call = literal_call(item)
            if not call:
                raise ProjectError(f"exposure {name}: depends_on takes literal ref and source calls")
            kind, first, last = call
            if kind == "ref":
                out.refs.append((first, last))
            elif first:
                out.sources.append((first, last))
        found.append(out)
    return found


_UNIT_KEYS = {"name", "model", "description", "given", "expect", "config"}


def read_unit_tests(raw: Any, package: str, file: str, path: str) -> list[UnitTest]:
    found = []
    for entry in entries(raw, "unit_tests"):
        name = named(entry, "unit_tests")
        if set(entry) - _UNIT_KEYS:
            raise ProjectError(f"unit test {name}: unsupported {sorted(set(entry) - _UNIT_KEYS)}")
        if not entry.get("model") or "given" not in entry or "expect" not in entry:
            raise ProjectError(f"unit test {name} needs model, given and expect")
        config = mapping(entry.get("config"), "config")
        model = entry["model"]
        out = UnitTest("unit_test", package, name, f"unit_test.{package}.{model}.{name}", path=path, file=file, description=entry.get("description") or "", model=model)
        out.enabled = flag(config["enabled"], "enabled") if "enabled" in config else True
        out.tags = names(config.get("tags"), "tags")
        out.given = [fixture(x, name) | {"input": x.get("input") or ""} for x in entries(entry["given"], "given")]
        out.expect = fixture(mapping(entry["expect"], "expect"), name)
        found.append(out)
    return found


def fixture(raw: dict[str, Any], where: str) -> dict[str, Any]:
    rows = raw.get("rows", [])
    if isinstance(rows, str) and rows:
        raise ProjectError(f"unit test {where}: rows must be a list of mappings")
    return {"rows": [dict(r) for r in rows or []], "format": raw.get("format"), "fixture": raw.get("fixture")}
