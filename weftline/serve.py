"""Serves the files of the target folder: GET and HEAD only, nothing outside it."""

from __future__ import annotations

from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote, urlsplit

from weftline.config import load_project
from weftline.errors import OK, ProjectError
from weftline.runner import Options


class Handler(SimpleHTTPRequestHandler):
    def send_head(self):
        path = unquote(urlsplit(self.path).path)
        there = (Path(self.directory) / path.lstrip("/")).resolve()
        if "\0" in path or ".." in Path(path).parts or not there.is_relative_to(Path(self.directory).resolve()):
            self.send_error(403)
            return None
        if there.is_dir() and not (there / "index.html").is_file():
            self.send_error(404)  # no listings
            return None
        return super().send_head()

    def log_message(self, format: str, *args) -> None:  # noqa: A002
        pass


def server(folder: Path, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), partial(Handler, directory=str(folder)))


def serve(o: Options, more: dict[str, str]) -> int:
    if "--browser" in more:
        raise ProjectError("docs serve doesn't open browsers; use --no-browser")
    port = more.get("--port", "8080")
    if not port.isdigit() or not 1 <= int(port) <= 65535:
        raise ProjectError("--port must be an integer between 1 and 65535")
    if "--host" in more and not more["--host"]:
        raise ProjectError("option `--host` requires a value")
    project = load_project(o.project_dir)
    folder = Path(o.project_dir) / (o.target_path or project.target_path)
    if not folder.is_dir():
        raise ProjectError(f"{folder} does not exist; run docs generate first")
    with server(folder, more.get("--host", "127.0.0.1"), int(port)) as s:
        print(f"Serving {folder} at http://{s.server_address[0]}:{s.server_address[1]}", flush=True)
        try:
            s.serve_forever()
        except KeyboardInterrupt:
            pass
    return OK
