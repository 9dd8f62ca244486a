"""Reads a project and its packages into a graph."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from weftline import properties, template
from weftline.config import PROJECT_FILE, ProjectConfig, flag, load_project, load_target, mapping, names, parse_vars, path_config, read_typed, read_yaml
from weftline.errors import ProjectError
from weftline.model import Graph, Macro, Node, Resource, Source, Test, TestConfig, TestSpec
from weftline.naming import BUILT_IN, model_argument, test_id, test_names
from weftline.resolve import resolve
from weftline.sources.files import discover

_CONFIG = {"materialized", "enabled", "tags", "schema", "alias", "store_failures"}
_DOC = re.compile(r"""\s*\{\{\s*doc\(\s*(['"])([^'"]+)\1\s*\)\s*\}\}\s*""")
_HEAD = re.compile(r"([A-Za-z_]\w*)\s*\((.*)\)\s*", re.S)
LANGUAGES = ("sql", "python")


class Loader:
    def __init__(self, root: str | Path, profiles_dir: str | None = None, profile: str | None = None, target: str | None = None, variables: str | None = None, target_path: str | None = None):
        self.root = load_project(root)
        self.given = parse_vars(variables)
        self.graph = Graph(self.root.name, str(root), load_target(self.root, profiles_dir, profile, target), target_path or self.root.target_path, self.root.vars | self.given)
        self.graph.dispatch = self.root.dispatch
        self.patches: list[tuple[str, str, dict[str, Any], str]] = []  # package, kind, entry, file

    def load(self) -> Graph:
        packages = [self.root]
        folder = self.root.root / "dbt_packages"
        if folder.is_dir():
            packages += [load_project(d) for d in sorted(folder.iterdir()) if (d / PROJECT_FILE).is_file()]
        for p in packages:
            self._macros(p)
        for p in packages:
            self._package(p)
        self._apply()
        self._generic_tests()
        resolve(self.graph)
        return self.graph

    # macros

    def _macros(self, p: ProjectConfig) -> None:
        for folder in p.paths["macro"]:
            for file in discover(p.root, folder, (".sql",)):
                for b in template.blocks((p.root / file).read_text()):
                    if b.kind != "docs":
                        self._macro(p.name, file, b)

    def _macro(self, package: str, file: str, b: template.Block) -> None:
        languages = None
        if b.kind == "materialization":
            name, _, rest = b.head.partition(",")
            adapter = re.search(r"adapter\s*=\s*['\"](\w+)['\"]", rest)
            listed = re.search(r"supported_languages\s*=\s*[\[(](.*?)[\])]", rest, re.S)
            languages = re.findall(r"['\"](\w+)['\"]", listed[1]) if listed else ["sql"]
            if any(x not in LANGUAGES for x in languages):
                raise ProjectError(f"{file}: unsupported language of materialization {name}")
            name, params = f"materialization_{name.strip()}_{adapter[1] if adapter else 'default'}", []
        else:
            m = _HEAD.fullmatch(b.head)
            if not m:
                raise ProjectError(f"{file}: malformed macro: {b.head}")
            name, params = m[1], _params(m[2], file)
            if b.kind in ("test", "data_test"):
                name = f"test_{name}"
        macro = Macro(package, name, f"macro.{package}.{name}", file, b.text, b.body, params, b.kind, languages=languages)
        if macro.unique_id in self.graph.macros:
            raise ProjectError(f"duplicate macro name: {macro.unique_id}")
        self.graph.macros[macro.unique_id] = macro

    # files of a package

    def _package(self, p: ProjectConfig) -> None:
        yml = (".yml", ".yaml")
        seen: set[str] = set()
        for kind in ("model", "seed", "analysis", "test", "macro", "docs"):
            for folder in p.paths[kind]:
                for file in discover(p.root, folder, (*yml, ".md", ".sql", ".csv")):
                    if file in seen:
                        continue
                    path = file.removeprefix(folder.rstrip("/") + "/")
                    text = "" if file.endswith(".csv") else (p.root / file).read_text()
                    if file.endswith(yml):
                        self._properties(p, file, path, text)
                    elif file.endswith(".md"):
                        self._docs(p, file, text)
                    elif file.endswith(".csv") and kind == "seed" or file.endswith(".sql") and kind in ("model", "analysis"):
                        self._node(p, kind, file, path, text)
                    elif file.endswith(".sql") and kind == "test" and not path.startswith("generic/"):
                        self._singular(p, file, path, text)
                    elif file.endswith(".sql") and kind == "test":
                        for b in template.blocks(text, ("test", "data_test", "macro")):
                            self._macro(p.name, file, b)
                    seen.add(file)

    def _add(self, r: Resource) -> None:
        if r.unique_id in self.graph.resources:
            raise ProjectError(f"duplicate {r.kind} name: {r.unique_id}")
        self.graph.resources[r.unique_id] = r

    def _docs(self, p: ProjectConfig, file: str, text: str) -> None:
        for b in template.blocks(text, ("docs",)):
            name = b.head.strip()
            if not re.fullmatch(r"[A-Za-z_]\w*", name):
                raise ProjectError(f"{file}: malformed docs block: {b.head}")
            key = f"doc.{p.name}.{name}"
            if key in self.graph.docs:
                raise ProjectError(f"duplicate docs block name: {key}")
            self.graph.docs[key] = (name, file, b.body.strip())

    def _node(self, p: ProjectConfig, kind: str, file: str, path: str, text: str) -> None:
        name = Path(file).stem
        node = Node(kind, p.name, name, f"{kind}.{p.name}.{name}", path=path, file=file, raw=text, root=str(p.root))
        if kind == "seed":
            node.materialized = "seed"
        else:
            self._refer(node, text)
            if kind == "analysis":
                node.materialized = "analysis"
        self._add(node)

    def _refer(self, r: Resource, text: str) -> None:
        try:
            found = template.scan(text, self.graph.vars)
        except template.TemplateError as e:
            raise ProjectError(f"{r.file}: {e}") from e
        r.refs, r.sources = found.refs, found.sources
        r.macros = [*found.calls]
        r.meta["_dispatched"] = found.dispatched
        if set(found.config) - _CONFIG - ({"severity", "where", "limit", "warn_if", "error_if"} if isinstance(r, Test) else set()):
            raise ProjectError(f"{r.file}: unsupported config {sorted(set(found.config) - _CONFIG)}")
        if isinstance(r, Node):
            r.inline = found.config
        elif isinstance(r, Test):
            r.config = properties.test_config({k: v if isinstance(v, list) else str(v) for k, v in found.config.items() if k not in ("alias", "schema", "materialized")}, r.file)
            r.enabled, r.tags = r.config.enabled, list(r.config.tags)

    def _singular(self, p: ProjectConfig, file: str, path: str, text: str) -> None:
        name = Path(file).stem
        test = Test("test", p.name, name, f"test.{p.name}.{name}", path=path, file=file, raw=text, singular=True, alias=name)
        self._refer(test, text)
        self._add(test)

    # properties

    def _properties(self, p: ProjectConfig, file: str, path: str, text: str) -> None:
        raw = mapping(read_yaml(text, file), file)
        for kind, key in (("model", "models"), ("seed", "seeds"), ("analysis", "analyses"), ("macro", "macros")):
            self.patches += [(p.name, kind, e, file) for e in properties.entries(raw.get(key), f"{file}: {key}")]
        for key in ("tests", "data_tests"):
            self.patches += [(p.name, "test", e, file) for e in properties.entries(raw.get(key), f"{file}: {key}")]
        tree = self.root.sources if p is self.root else p.sources | self.root.sources
        found: list[Resource] = [
            *properties.read_sources(raw.get("sources"), p.name, file, path, tree, self.graph.target.schema),
            *properties.read_exposures(raw.get("exposures"), p.name, file, path),
            *(properties.read_unit_tests(mapping(read_typed(text, file), file).get("unit_tests"), p.name, file, path) if raw.get("unit_tests") else []),
        ]
        for r in found:
            self._add(r)

    def _apply(self) -> None:
        done: set[tuple[str, str, str]] = set()
        patched: dict[str, dict[str, Any]] = {}
        for package, kind, entry, file in self.patches:
            name = properties.named(entry, file)
            if kind == "macro":
                self._patch_macro(package, name, entry, file, done)
                continue
            r = self.graph.resources.get(f"{kind}.{package}.{name}")
            if r is None or kind == "test" and not (isinstance(r, Test) and r.singular):
                self.graph.warnings.append(f"no {kind} named {name} for the properties in {file}")
                continue
            r.patch_path = f"{package}://{file}"
            config = mapping(entry.get("config"), f"{file}: config")
            r.description = entry.get("description") or r.description
            if isinstance(r, Test):
                r.config = properties.test_config(config, file, r.config, strict=True)
                r.enabled, r.tags = r.config.enabled, list(dict.fromkeys(r.config.tags))
                continue
            assert isinstance(r, Node)
            patched[r.unique_id] = {k: v for k, v in config.items()} | {"tags": names(entry.get("tags"), "tags") + names(config.get("tags"), "tags")}
            for k, c in properties.columns(entry.get("columns"), f"{file}: {name}").items():
                if k in r.columns:
                    r.columns[k].tests += c.tests
                    r.columns[k].description = c.description or r.columns[k].description
                else:
                    r.columns[k] = c
            r.tests += properties.test_specs(entry.get("tests"), f"{file}: {name}") + properties.test_specs(entry.get("data_tests"), f"{file}: {name}")
        for r in self.graph.of("model", "seed", "analysis", enabled=False):
            self._settle(r, patched.get(r.unique_id, {}))
        self._describe()

    def _settle(self, node: Node, yaml: dict[str, Any]) -> None:
        """Precedence, weakest first: own project's paths, YAML, the file itself; the root's paths over a package's nodes."""
        tree = {"model": self.root.models, "seed": self.root.seeds}.get(node.kind, {})
        levels = path_config(tree, node.package, node.path)
        own = node.package == self.root.name
        paths: dict[str, Any] = {}
        tags: list[str] = []
        for level in levels:
            tags += names(level.get("tags"), "tags")
            if "docs" in level:
                node.docs |= {k: (flag(v, "show") if k == "show" else v) for k, v in mapping(level["docs"], "docs").items() if k in ("show", "node_color")}
            paths |= {k: level[k] for k in ("materialized", "schema", "enabled") if k in level}
        inline = node.inline
        order = [paths, yaml, inline] if own else [yaml, inline, paths]
        merged: dict[str, Any] = {}
        for level in order:
            merged |= {k: v for k, v in level.items() if k != "tags" and v not in (None, "")}
        if node.kind == "model" and merged.get("materialized"):
            node.materialized = str(merged["materialized"])
        node.schema, node.alias = merged.get("schema"), merged.get("alias")
        if "enabled" in merged:
            node.enabled = flag(merged["enabled"], "enabled")
        if merged.get("store_failures") is not None:
            node.store_failures = flag(merged["store_failures"], "store_failures")
        node.tags = list(dict.fromkeys([*tags, *yaml.get("tags", []), *names(inline.get("tags"), "tags")]))
        if node.kind == "seed":
            if yaml.get("quote_columns") not in (None, ""):
                node.quote_columns = flag(yaml["quote_columns"], "quote_columns")
            types = yaml.get("column_types")
            if isinstance(types, str) and types:
                raise ProjectError(f"seed {node.name}: column_types must be a mapping")
            node.column_types = dict(types or {})

    def _patch_macro(self, package: str, name: str, entry: dict[str, Any], file: str, done: set) -> None:
        if ("macro", package, name) in done:
            raise ProjectError(f"duplicate macro property patch: {name}")
        done.add(("macro", package, name))
        macro = self.graph.macros.get(f"macro.{package}.{name}") or self.graph.macros.get(f"macro.{package}.test_{name}")
        if macro is None:
            self.graph.warnings.append(f"no macro named {name} for the properties in {file}")
            return
        macro.description, macro.patch_path = entry.get("description") or "", f"{package}://{file}"
        macro.meta = mapping(entry.get("meta"), "meta")
        docs = mapping(entry.get("docs"), "docs")
        macro.docs |= {k: (flag(v, "show") if k == "show" else v) for k, v in docs.items()}
        macro.arguments = [{"name": properties.named(a, name), "type": a.get("type"), "description": a.get("description") or ""} for a in properties.entries(entry.get("arguments"), f"macro {name}")]
        if self.root.validate_macro_args:
            have, listed = [p for p, _ in macro.params], [a["name"] for a in macro.arguments]
            if len(have) != len(listed):
                self.graph.warnings.append(f"macro {name} has {len(have)} arguments, its properties list {len(listed)}")
            for a in macro.arguments:
                if a["name"] not in have:
                    self.graph.warnings.append(f"macro {name} has no argument {a['name']}")
                if a["type"] and not valid_type(a["type"]):
                    self.graph.warnings.append(f"macro {name}: argument {a['name']} has an unknown type {a['type']}")

    def _describe(self) -> None:
        """Descriptions that are a call of doc() become the block's text."""

        def told(text: str, package: str, blocks: list[str]) -> str:
            m = _DOC.fullmatch(text)
            if not m:
                if "doc(" in text and "{{" in text:
                    raise ProjectError("unsupported dynamic doc; descriptions take one literal doc call")
                return text
            for key in (f"doc.{package}.{m[2]}", *(k for k in self.graph.docs if k.split(".")[-1] == m[2])):
                if key in self.graph.docs:
                    blocks.append(key)
                    return self.graph.docs[key][2]
            raise ProjectError(f"unresolved doc reference: {m[2]}")

        for r in self.graph.resources.values():
            r.description = told(r.description, r.package, r.doc_blocks)
            for c in r.columns.values():
                c.description = told(c.description, r.package, c.doc_blocks)

    # generic tests

    def _generic_tests(self) -> None:
        for r in self.graph.of("model", "seed", "source"):
            for spec in r.tests:
                if isinstance(r, Source) and not spec.column:
                    continue
                self._generic(r, spec, None)
            for column in r.columns.values():
                for spec in column.tests:
                    self._generic(r, spec, column.name)

    def _generic(self, of: Node | Source, spec: TestSpec, column: str | None) -> None:
        source = isinstance(of, Source)
        place = column or spec.column
        label = f"{of.source_name}_{of.name}" if source else of.name
        argument = f"source('{of.source_name}', '{of.name}')" if source else f"ref('{of.name}')"
        full, alias = test_names(spec, label, place, "source_" if source else "")
        key = test_id(of.package, full, spec, model_argument(argument), place, source)
        if key in self.graph.resources:
            return
        call = f"{spec.namespace + '.' if spec.namespace else ''}test_{spec.name}"
        raw = f"{{{{ {call}(**_dbt_generic_test_kwargs) }}}}" + ("" if alias == full else f'{{{{ config(alias="{alias}") }}}}')
        file = (of.patch_path or of.file).split("://")[-1]
        test = Test("test", of.package, full, key, path=f"{alias}.sql", file=file, raw=raw, alias=alias, spec=spec, attached=of.unique_id, column=place, config=spec.config or TestConfig())
        test.enabled, test.tags = test.config.enabled, list(test.config.tags)
        test.depends_on = [of.unique_id]
        if source:
            test.sources = [(of.source_name, of.name)]
        else:
            test.refs = [(None, of.name)]
        if spec.name == "relationships" and (to := properties.literal_call(spec.to)):
            if to[0] == "ref":
                template.add_once(test.refs, (to[1], to[2]))
            elif to[1]:
                template.add_once(test.sources, (to[1], to[2]))
        if spec.name not in BUILT_IN or spec.namespace:
            space = spec.namespace or self.root.name
            macro = self.graph.macros.get(f"macro.{space}.test_{spec.name}")
            if macro is None:
                raise ProjectError(f"unresolved test: {call}")
            if column is None:
                raise ProjectError(f"custom test {spec.name} is supported on columns only")
            test.macro = macro.unique_id
        self.graph.resources[key] = test


def _params(text: str, file: str) -> list[tuple[str, str | None]]:
    found = []
    depth, item = 0, ""
    for c in text + ",":
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            if item.strip():
                name, _, default = item.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise ProjectError(f"{file}: malformed macro arguments: {text}")
                found.append((name.strip(), default.strip() or None))
            item = ""
        else:
            item += c
    return found


_PLAIN_TYPES = ("str", "string", "bool", "int", "integer", "float", "any", "relation", "column")


def valid_type(text: str) -> bool:
    """Whether a documented argument type is one of the known ones."""
    text = re.sub(r"\s", "", text)
    if text in _PLAIN_TYPES:
        return True
    m = re.fullmatch(r"(list|optional)\[(.*)\]", text)
    if m:
        return valid_type(m[2])
    m = re.fullmatch(r"dict\[(.*)\]", text)
    return bool(m) and any(valid_type(m[1][:i]) and valid_type(m[1][i + 1 :]) for i, c in enumerate(m[1]) if c == ",")
