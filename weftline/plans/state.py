"""Prior artifacts that selectors ask for."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weftline.errors import ProjectError

RESULTS = ("success", "error", "fail", "skipped")
FRESHNESS = ("pass", "warn", "error")


def _read(folder: str | None, name: str, version: str, what: str) -> dict[str, Any]:
    if not folder:
        raise ProjectError(f"{what} selectors require --state, a directory with {name}")
    file = Path(folder) / name
    if not file.is_file():
        raise ProjectError(f"--state must point to a directory with {name} for {what} selectors")
    try:
        raw = json.loads(file.read_text())
        schema = raw["metadata"]["dbt_schema_version"]
    except (ValueError, KeyError, TypeError) as e:
        raise ProjectError(f"{name} is malformed") from e
    if version not in str(schema):
        raise ProjectError(f"{name} must use schema {version} for {what} selectors")
    return raw


def _statuses(raw: dict[str, Any], name: str) -> dict[str, str]:
    try:
        return {r["unique_id"]: str(r["status"]) for r in raw["results"]}
    except (KeyError, TypeError) as e:
        raise ProjectError(f"{name} is malformed or lacks result fields") from e


@dataclass
class State:
    """Lookups by unique id; each is read when first asked for."""

    folder: str | None = None
    _kept: dict[str, Any] = field(default_factory=dict)

    def known(self) -> set[str]:
        if "known" not in self._kept:
            raw = _read(self.folder, "manifest.json", "/manifest/v12", "state")
            found: set[str] = set()
            for part in ("nodes", "sources", "exposures", "unit_tests"):
                if not isinstance(raw.get(part), dict):
                    raise ProjectError("manifest.json is malformed or lacks state fields")
                found |= {str(v.get("unique_id", k)) for k, v in raw[part].items()}
            self._kept["known"] = found
        return self._kept["known"]

    def results(self) -> dict[str, str]:
        if "results" not in self._kept:
            self._kept["results"] = _statuses(_read(self.folder, "run_results.json", "/run-results/v6", "result"), "run_results.json")
        return self._kept["results"]

    def freshness(self) -> dict[str, str]:
        if "freshness" not in self._kept:
            self._kept["freshness"] = _statuses(_read(self.folder, "sources.json", "/sources/v3", "source_status"), "sources.json")
        return self._kept["freshness"]
