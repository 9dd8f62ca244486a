"""Errors that end a command, with their exit codes."""

from __future__ import annotations

OK, FAILURE, USAGE = 0, 1, 2


class ProjectError(Exception):
    """The project, a selector or an option can't be used as given."""

    code = USAGE


class ResourceFailure(ProjectError):
    """Selected resources ran and some of them failed."""

    code = FAILURE

    def __init__(self, message: str, results: list | None = None):
        super().__init__(message)
        self.results = results or []
