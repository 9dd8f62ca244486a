"""Files of a project."""

from __future__ import annotations

import os
from pathlib import Path

#: folders that never hold sources
SKIPPED = {"target", "dbt_packages", "dbt_modules", "logs", "__pycache__"}


def discover(root: Path, folder: str, suffixes: tuple[str, ...]) -> list[str]:
    """Paths below ``root`` (with /) of the files in a folder, sorted; hidden ones are passed over."""
    found = []
    for top, folders, files in os.walk(root / folder):
        folders[:] = [d for d in folders if not d.startswith(".") and d not in SKIPPED]
        found += [Path(top, f).relative_to(root).as_posix() for f in files if not f.startswith(".") and f.endswith(suffixes)]
    return sorted(found)


def inside(path: str) -> bool:
    """Whether a path stays below the folder it is relative to."""
    return bool(path) and not os.path.isabs(path) and ".." not in Path(path).parts
