"""Command line: ``python -m weftline COMMAND [OPTIONS]``."""

from __future__ import annotations

import sys
from pathlib import Path

from weftline import __version__
from weftline.errors import FAILURE, OK, USAGE, ProjectError, ResourceFailure
from weftline.model import KINDS, Graph
from weftline.plans.select import parse as parse_selector
from weftline.runner import Options, Project, clean, summary

#: option: (field, takes a value); the last ones take several
_VALUES = {"--project-dir": "project_dir", "--profiles-dir": "profiles_dir", "--profile": "profile", "--target": "target", "--vars": "vars", "--target-path": "target_path", "--state": "state", "--threads": "threads", "--resource-type": "resource_type", "--output": "output", "--host": "host", "--port": "port"}
_SEVERAL = {"--select": "select", "-s": "select", "--models": "select", "--exclude": "exclude", "--selector": "selector", "--output-keys": "output_keys"}
_FLAGS = {"--full-refresh", "--no-browser", "--no-open", "--browser", "--clean-project-files-only", "--no-clean-project-files-only"}
_PROJECT = {"--project-dir", "--profiles-dir", "--profile", "--target", "--vars", "--target-path", "--state", "--threads", "--select", "-s", "--models", "--exclude", "--selector"}
#: what each command accepts
COMMANDS: dict[str, set[str]] = {
    "parse": _PROJECT,
    "compile": _PROJECT | {"--resource-type"},
    "ls": (_PROJECT - {"--target-path"}) | {"--resource-type", "--output", "--output-keys"},
    "run": _PROJECT | {"--full-refresh"},
    "seed": _PROJECT | {"--full-refresh"},
    "test": _PROJECT,
    "build": _PROJECT | {"--full-refresh", "--resource-type"},
    "clean": {"--project-dir", "--clean-project-files-only", "--no-clean-project-files-only"},
    "source freshness": _PROJECT,
    "docs generate": _PROJECT,
    "docs serve": {"--project-dir", "--target-path", "--host", "--port", "--browser", "--no-browser", "--no-open"},
}
TOLD = {
    "parse": "read the project and write manifest.json",
    "compile": "render templates to SQL",
    "ls": "list resources",
    "run": "build models",
    "seed": "load CSV files",
    "test": "run data tests and unit tests",
    "build": "run seeds, models and tests in the order of the graph",
    "clean": "remove the clean-targets of the project",
    "source freshness": "check how old the data of sources is",
    "docs generate": "write manifest.json and catalog.json",
    "docs serve": "serve the target folder over HTTP",
}


def usage() -> str:
    return "usage: weftline COMMAND [OPTIONS]\n\n" + "".join(f"  {k:18}{v}\n" for k, v in TOLD.items()) + "  version           print the version\n"


def options(command: str, args: list[str]) -> tuple[Options, dict[str, str]]:
    """Options of a command, and those that only ``docs serve`` and ``clean`` know."""
    found, more = Options(), {}
    several: dict[str, list[str]] = {}
    i = 0
    while i < len(args):
        name, equals, value = args[i].partition("=")
        if name not in COMMANDS[command]:
            raise ProjectError(f"unsupported option `{args[i]}` of {command}")
        i += 1
        if name in _FLAGS:
            more[name] = "true"
        elif name in _SEVERAL:
            values = [value] if equals else []
            while not equals and i < len(args) and not args[i].startswith("-"):
                values.append(args[i])
                i += 1
            if not values or not all(values):
                raise ProjectError(f"option `{name}` requires a value")
            several.setdefault(_SEVERAL[name], []).extend(values)
        else:
            if not equals:
                if i >= len(args):
                    raise ProjectError(f"option `{name}` requires a value")
                value = args[i]
                i += 1
            if name in ("--host", "--port"):
                more[name] = value
            elif name == "--threads":
                if not value.isdigit() or not int(value):
                    raise ProjectError("--threads must be a positive integer")
                found.threads = int(value)
            else:
                setattr(found, _VALUES[name], value)
    for name, values in several.items():
        if name in ("select", "exclude"):
            for v in values:
                parse_selector(v)
        setattr(found, name, values if name == "output_keys" else " ".join(values))
    if found.output not in ("text", "json", "name", "path", "selector"):
        raise ProjectError("--output must be text, json, name, path, or selector")
    if found.resource_type and found.resource_type not in KINDS:
        raise ProjectError(f"--resource-type must be one of {', '.join(KINDS)}")
    return found, more


def session(graph: Graph):
    """A session whose tables outlive the command.

    A cluster's own warehouse and catalog are used as they are configured; on a single machine without
    them, both lie beside the target's path.
    """
    from pyspark import SparkConf, SparkContext
    from pyspark.sql import SparkSession

    SparkContext._ensure_initialized()  # so that the configuration holds what was submitted
    given = SparkConf()
    if not given.get("spark.master", "local").startswith("local") or given.contains("spark.sql.warehouse.dir"):
        return SparkSession.builder.appName("weftline").getOrCreate()
    home = Path(graph.target.path) if graph.target.path else Path(graph.root) / graph.target_path / "warehouse"
    home = home.with_suffix("") if home.suffix else home
    home.mkdir(parents=True, exist_ok=True)
    build = SparkSession.builder.appName("weftline").config("spark.sql.warehouse.dir", str((home / "data").resolve())).config("spark.sql.catalogImplementation", "hive")
    build = build.config("spark.hadoop.javax.jdo.option.ConnectionURL", f"jdbc:derby:;databaseName={(home / 'metastore').resolve()};create=true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return build.getOrCreate()


def main(argv: list[str] | None = None, new_session=session) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if not args or args[0] in ("-h", "--help", "help"):
        print(usage(), end="")
        return OK
    if args[0] in ("version", "--version"):
        print(__version__ if args[0] == "version" else f"weftline {__version__}")
        return OK
    command = " ".join(args[:2]) if args[0] in ("source", "docs") else args[0]
    if command not in COMMANDS:
        print(f"error: unknown command `{command}`\n\n{usage()}", end="", file=sys.stderr)
        return USAGE
    rest = args[len(command.split()) :]
    if "-h" in rest or "--help" in rest:
        print(f"usage: weftline {command} [OPTIONS]\n\n{TOLD[command]}\n\noptions: {', '.join(sorted(COMMANDS[command]))}")
        return OK
    try:
        return _command(command, rest, new_session)
    except ResourceFailure as e:
        _told(e.results)
        print(f"error: {e}", file=sys.stderr)
        return FAILURE
    except ProjectError as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE


def _told(results: list) -> None:
    for r in results:
        print(f"{r.status} {r.unique_id}" + (f": {r.message}" if getattr(r, "message", None) else ""))
    counts = summary(results)
    print(f"{len(results)} result(s): " + ", ".join(f"{n} {k}" for k, n in sorted(counts.items())))
    failed = [r for r in results if r.status == "fail"]
    if failed:
        print(f"{len(failed)} test(s) failed with {sum(r.failures or 0 for r in failed)} failure row(s)")


def _command(command: str, rest: list[str], new_session) -> int:
    o, more = options(command, rest)
    if command == "clean":
        if "--no-clean-project-files-only" in more:
            raise ProjectError("clean removes paths in the project only")
        for t in clean(o):
            print(f"Removed {t}")
        return OK
    if command == "docs serve":
        from weftline.serve import serve

        return serve(o, more)
    project = Project(o, new_session)
    for w in project.graph.warnings:
        print(f"warning: {w}", file=sys.stderr)
    target = project.folder
    if command == "parse":
        n = project.parse()
        print(f"Parsed {n['model']} model(s), {n['analysis']} analysis(es), {n['seed']} seed(s), {n['source']} source(s), {n['exposure']} exposure(s), and {n['unit_test']} unit test(s) into {target}")
    elif command == "ls":
        for line in project.list():
            print(line)
    elif command == "compile":
        n = project.compile()
        print(f"Compiled {n['model']} model(s), {n['analysis']} analysis(es), and {n['test']} test(s) into {target}")
    elif command == "docs generate":
        print(f"Generated docs artifacts for {project.docs_generate()} compiled model(s) into {target}")
    elif command == "source freshness":
        results = project.source_freshness()
        print(f"Checked freshness for {len(results)} source(s); wrote artifacts into {target}")
    else:
        results = getattr(project, command)()
        _told(results)
        print(f"Wrote artifacts into {target}")
    return OK
