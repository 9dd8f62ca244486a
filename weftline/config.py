"""Project file, profile and variables.

YAML scalars are read as the strings they are written as; what is a number or a flag is decided where
it is used, so ``values: [1, true]`` keeps its spelling.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from weftline.errors import ProjectError
from weftline.model import Target

PROJECT_FILE = "dbt_project.yml"


def read_yaml(text: str, where: str) -> Any:
    try:
        return yaml.load(text, Loader=yaml.BaseLoader)  # noqa: S506  strings only
    except yaml.YAMLError as e:
        raise ProjectError(f"unsupported YAML in {where}: {e}") from e


def flag(value: Any, where: str) -> bool:
    low = str(value).strip().lower()
    if low not in ("true", "false"):
        raise ProjectError(f"{where} must be true or false, not {value!r}")
    return low == "true"


def names(value: Any, where: str) -> list[str]:
    """A list of strings; a single string is a list of one."""
    if value in (None, ""):
        return []
    if isinstance(value, str):
        return [value]
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ProjectError(f"{where} must be a list of strings")
    return list(value)


def mapping(value: Any, where: str) -> dict[str, Any]:
    if value in (None, ""):
        return {}
    if not isinstance(value, dict):
        raise ProjectError(f"{where} must be a mapping")
    return value


@dataclass
class ProjectConfig:
    name: str
    root: Path
    profile: str | None = None
    paths: dict[str, list[str]] = field(default_factory=dict)  # by kind: model, seed, analysis, test, macro, docs
    target_path: str = "target"
    clean_targets: list[str] = field(default_factory=lambda: ["target"])
    vars: dict[str, str] = field(default_factory=dict)
    models: dict[str, Any] = field(default_factory=dict)
    seeds: dict[str, Any] = field(default_factory=dict)
    sources: dict[str, Any] = field(default_factory=dict)
    dispatch: dict[str, list[str]] = field(default_factory=dict)
    validate_macro_args: bool = False


_PATHS = {"model": ["models"], "seed": ["seeds"], "analysis": ["analyses"], "test": ["tests"], "macro": ["macros"]}


def load_project(root: str | Path) -> ProjectConfig:
    root = Path(root)
    file = root / PROJECT_FILE
    if not file.is_file():
        raise ProjectError(f"missing {PROJECT_FILE}")
    raw = mapping(read_yaml(file.read_text(), PROJECT_FILE), PROJECT_FILE)
    name = raw.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ProjectError(f"{PROJECT_FILE} must define a non-empty name")
    paths = {k: names(raw.get(f"{k}-paths"), f"{k}-paths") or list(default) for k, default in _PATHS.items()}
    paths["docs"] = names(raw.get("docs-paths"), "docs-paths")
    dispatch = {}
    for entry in raw.get("dispatch") or []:
        entry = mapping(entry, "dispatch")
        if not entry.get("macro_namespace") or not entry.get("search_order"):
            raise ProjectError("dispatch needs macro_namespace and search_order")
        dispatch[entry["macro_namespace"]] = names(entry["search_order"], "search_order")
    flags = mapping(raw.get("flags"), "flags")
    return ProjectConfig(
        name=name.strip(),
        root=root,
        profile=raw.get("profile") or None,
        paths=paths,
        target_path=raw.get("target-path") or "target",
        clean_targets=names(raw.get("clean-targets"), "clean-targets") if "clean-targets" in raw else [raw.get("target-path") or "target"],
        vars=scalars(raw.get("vars"), nested="skip"),
        models=mapping(raw.get("models"), "models"),
        seeds=mapping(raw.get("seeds"), "seeds"),
        sources=mapping(raw.get("sources"), "sources"),
        dispatch=dispatch,
        validate_macro_args=flag(flags["validate_macro_args"], "validate_macro_args") if "validate_macro_args" in flags else False,
    )


def scalars(raw: Any, nested: str) -> dict[str, str]:
    """Variables as strings; nested values are an error, or maps are skipped."""
    found = {}
    for k, v in mapping(raw, "vars").items():
        if isinstance(v, dict) and nested == "skip":
            continue
        if not isinstance(v, str):
            raise ProjectError(f"var {k} must be a scalar")
        found[k] = v
    return found


def parse_vars(text: str | None) -> dict[str, str]:
    """The value of --vars: JSON or YAML."""
    if not text or not text.strip():
        return {}
    raw = read_yaml(text, "--vars")
    if not isinstance(raw, dict):
        raw = read_yaml(text.replace(":", ": "), "--vars")
    return scalars(raw, nested="error")


def load_target(project: ProjectConfig, profiles_dir: str | None, profile: str | None, target: str | None) -> Target:
    """The chosen output.  Without a profiles file the defaults hold, unless one was asked for."""
    folder = Path(profiles_dir) if profiles_dir else project.root
    file = folder / "profiles.yml"
    chosen = profile or project.profile
    if not file.is_file():
        if target or profile or profiles_dir:
            raise ProjectError("missing profiles.yml for the selected profile and target")
        return Target(profile=chosen or "default")
    if not chosen:
        raise ProjectError("no profile was specified")
    raw = mapping(read_yaml(file.read_text(), "profiles.yml"), "profiles.yml")
    if chosen not in raw:
        if profile or target:
            raise ProjectError(f"profile {chosen} was not found in profiles.yml")
        return Target(profile=chosen)
    own = mapping(raw[chosen], chosen)
    outputs = mapping(own.get("outputs"), "outputs")
    if not outputs:
        raise ProjectError(f"profile {chosen} must define outputs")
    name = target or own.get("target") or "default"
    if name not in outputs:
        raise ProjectError(f"target {name} was not found in profile {chosen}")
    out = mapping(outputs[name], name)
    kind = (out.get("type") or "").strip()
    if not kind:
        raise ProjectError(f"target {name} must define a type")
    if "schema" in out and not str(out["schema"]).strip():
        raise ProjectError(f"target {name}: schema must not be empty")
    if "path" in out and not str(out["path"]).strip():
        raise ProjectError(f"target {name}: path must not be empty")
    path = out.get("path")
    if path and kind in ("duckdb", "spark"):
        if path == ":memory:" or path.startswith(("md:", "motherduck:")):
            raise ProjectError(f"only local paths are supported, not {path}")
        path = path if os.path.isabs(path) else str(folder / path)
    return Target(profile=chosen, name=name, type={"postgresql": "postgres"}.get(kind, kind), schema=str(out.get("schema") or "main"), path=path)


def path_config(tree: dict[str, Any], package: str, path: str) -> list[dict[str, Any]]:
    """The ``+`` settings on the way to a resource, outermost first."""
    found = [{k[1:]: v for k, v in tree.items() if k.startswith("+")}]
    at = tree.get(package)
    steps = path.rsplit(".", 1)[0].split("/")
    while isinstance(at, dict):
        found.append({k[1:]: v for k, v in at.items() if k.startswith("+")})
        at = at.get(steps.pop(0)) if steps else None
    return [x for x in found if x]


class _Typed(yaml.SafeLoader):
    """JSON's numbers, true, false and null are typed; everything else is a string."""


_Typed.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("tag:yaml.org,2002:bool", r"^(?:true|false|True|False|TRUE|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:int", r"^-?(?:0|[1-9][0-9]*)$", "-0123456789"),
    ("tag:yaml.org,2002:float", r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$", "-0123456789"),
    ("tag:yaml.org,2002:null", r"^(?:null|Null|NULL|~|)$", ["n", "N", "~", ""]),
):
    _Typed.add_implicit_resolver(_tag, re.compile(_pattern), list(_first))


def read_typed(text: str, where: str) -> Any:
    try:
        return yaml.load(text, Loader=_Typed)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise ProjectError(f"unsupported YAML in {where}: {e}") from e
