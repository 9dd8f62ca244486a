"""Templated SQL: text with ``{{ }}``, ``{% %}`` and ``{# #}``, parsed once into a tree.

The tree is walked in two ways.  ``scan`` visits every branch and collects what a file refers to;
``Renderer`` takes the branches that hold and gives SQL.  Only what both understand is accepted;
anything else is an error, never an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from weftline.errors import ProjectError

MOST_DEPTH = 8


class TemplateError(ProjectError):
    pass


# expressions


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    path: str  # dotted


@dataclass(frozen=True)
class Call:
    target: Any  # Name or Call
    args: tuple
    named: tuple  # of (name, expression)


@dataclass(frozen=True)
class Items:
    items: tuple


@dataclass(frozen=True)
class Pairs:
    items: tuple


@dataclass(frozen=True)
class Compare:
    left: Any
    op: str
    right: Any


@dataclass(frozen=True)
class Not:
    inner: Any


_LEX = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[()\[\]{}.,=:]))""")


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"unsupported template expression: {text}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at, self.text = 0, text

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        value = self.peek()
        if not value or want and value != want:
            raise TemplateError(f"unsupported template expression: {self.text}")
        self.at += 1
        return value

    def whole(self) -> Any:
        found = self.condition()
        if self.at != len(self.tokens):
            raise TemplateError(f"unsupported template expression: {self.text}")
        return found

    def condition(self) -> Any:
        if self.kind() == "name" and self.peek() == "not":
            self.take()
            return Not(self.condition())
        left = self.value()
        if self.peek() in ("==", "!="):
            op = self.take()
            return Compare(left, op, self.value())
        return left

    def value(self) -> Any:
        kind = self.kind()
        if kind == "string":
            return Literal(_unescape(self.take()))
        if kind == "number":
            raw = self.take()
            return Literal(float(raw) if "." in raw else int(raw))
        if self.peek() in ("[", "("):
            close = {"[": "]", "(": ")"}[self.take()]
            items = []
            while self.peek() != close:
                items.append(self.condition())
                if self.peek() != close:
                    self.take(",")
            self.take(close)
            return Items(tuple(items))
        if self.peek() == "{":
            self.take()
            pairs = []
            while self.peek() != "}":
                key = self.value()
                self.take(":")
                pairs.append((key, self.condition()))
                if self.peek() != "}":
                    self.take(",")
            self.take("}")
            return Pairs(tuple(pairs))
        if kind != "name":
            raise TemplateError(f"unsupported template expression: {self.text}")
        path = self.take()
        while self.peek() == ".":
            self.take()
            if self.kind() != "name":
                raise TemplateError(f"unsupported template expression: {self.text}")
            path += "." + self.take()
        found: Any = {"true": Literal(True), "True": Literal(True), "false": Literal(False), "False": Literal(False), "none": Literal(None), "None": Literal(None)}.get(path) or Name(path)
        while self.peek() == "(":
            self.take()
            args, named = [], []
            while self.peek() != ")":
                if self.kind() == "name" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "=":
                    key = self.take()
                    self.take("=")
                    named.append((key, self.condition()))
                else:
                    if named:
                        raise TemplateError(f"unsupported template expression: {self.text}")
                    args.append(self.condition())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            found = Call(found, tuple(args), tuple(named))
        return found


def _unescape(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), raw[1:-1])


def expression(text: str) -> Any:
    return _Parser(text).whole()


# statements


@dataclass
class Text:
    text: str


@dataclass
class Output:
    value: Any


@dataclass
class SetList:
    name: str
    value: Any


@dataclass
class For:
    name: str
    items: Any
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list[tuple[Any, list]] = field(default_factory=list)  # a condition of None is the else


@dataclass
class Block:
    """A macro, test, data_test, materialization or docs block."""

    kind: str
    head: str
    body: str
    text: str


_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?P<out>.*?)-?\}\}|\{%-?\s*raw\s*-?%\}(?P<raw>.*?)\{%-?\s*endraw\s*-?%\}|\{%-?(?P<tag>.*?)-?%\}", re.S)
_BLOCKS = ("macro", "test", "data_test", "materialization", "docs")


def parse(text: str) -> list:
    """The tree of a template without definition blocks."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for m in _TAG.finditer(text):
        plain = text[at : m.start()]
        _no_tags(plain)
        here = stack[-1][2]
        if plain:
            here.append(Text(plain))
        at = m.end()
        if m["raw"] is not None:
            here.append(Text(m["raw"]))
        elif m["out"] is not None:
            here.append(Output(expression(m["out"])))
        elif m["tag"] is not None:
            _tag(m["tag"].strip(), stack)
    _no_tags(text[at:])
    if text[at:]:
        stack[-1][2].append(Text(text[at:]))
    if len(stack) != 1:
        raise TemplateError(f"a {stack[-1][0]} block is not closed")
    return root


def _no_tags(text: str) -> None:
    if "{{" in text or "{%" in text:
        raise TemplateError("malformed template: a tag is not closed")


def _tag(tag: str, stack: list[tuple[str, Any, list]]) -> None:
    word, _, rest = tag.partition(" ")
    if word == "set":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.*)", rest.strip(), re.S)
        if not m:
            raise TemplateError(f"unsupported statement: {tag}")
        value = expression(m[2])
        if not (isinstance(value, Items) and all(isinstance(x, Literal) and isinstance(x.value, str) for x in value.items)):
            raise TemplateError(f"only lists of strings can be set: {tag}")
        stack[-1][2].append(SetList(m[1], value))
    elif word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
        if not m:
            raise TemplateError(f"unsupported statement: {tag}")
        made = For(m[1], expression(m[2]))
        stack[-1][2].append(made)
        stack.append(("for", made, made.body))
    elif word == "if":
        arm: list = []
        chosen = If([(expression(rest), arm)])
        stack[-1][2].append(chosen)
        stack.append(("if", chosen, arm))
    elif word in ("elif", "else"):
        kind, owner, _ = stack.pop()
        if kind != "if" or owner.arms[-1][0] is None:
            raise TemplateError(f"unsupported statement: {tag}")
        arm = []
        owner.arms.append((expression(rest) if word == "elif" else None, arm))
        stack.append(("if", owner, arm))
    elif word in ("endfor", "endif"):
        if stack[-1][0] != word[3:]:
            raise TemplateError(f"unsupported statement: {tag}")
        stack.pop()
    else:
        raise TemplateError(f"unsupported statement: {tag}")


def blocks(text: str, kinds: tuple[str, ...] = _BLOCKS) -> list[Block]:
    """Definition blocks of a file; comments, raw spans and outputs between them are passed over."""
    found: list[Block] = []
    tags = [m for m in _TAG.finditer(text) if m["tag"] is not None]
    k = 0
    while k < len(tags):
        word, _, head = tags[k]["tag"].strip().partition(" ")
        if word in kinds:
            for j in range(k + 1, len(tags)):
                inner = tags[j]["tag"].strip().partition(" ")[0]
                if inner == "end" + word:
                    found.append(Block(word, head.strip(), text[tags[k].end() : tags[j].start()], text[tags[k].start() : tags[j].end()]))
                    k = j
                    break
                if inner in kinds:
                    raise TemplateError(f"malformed {word} block: {head}")
            else:
                raise TemplateError(f"malformed {word} block: {head}")
        elif word.startswith("end") and word[3:] in kinds:
            raise TemplateError(f"malformed {word[3:]} block")
        k += 1
    return found


# what a file refers to


@dataclass
class Found:
    refs: list[tuple[str | None, str]] = field(default_factory=list)
    sources: list[tuple[str, str]] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)  # names of macros, dotted with a package
    dispatched: list[tuple[str, str | None]] = field(default_factory=list)
    config: dict[str, Any] = field(default_factory=dict)


#: names that are no macros
_KNOWN = {"ref", "source", "config", "var", "return", "adapter.dispatch", "is_incremental"}


def add_once(items: list, item: Any) -> None:
    if item not in items:
        items.append(item)


def constant(value: Any, names: dict[str, Any], variables: dict[str, str]) -> Any:
    """The value of a literal, a bound name or a ``var`` call."""
    if isinstance(value, Literal):
        return value.value
    if isinstance(value, Items):
        return [constant(x, names, variables) for x in value.items]
    if isinstance(value, Pairs):
        return {constant(k, names, variables): constant(v, names, variables) for k, v in value.items}
    if isinstance(value, Name) and value.path in names:
        return names[value.path]
    if isinstance(value, Call) and value.target == Name("var"):
        if value.named or not 1 <= len(value.args) <= 2 or not all(isinstance(x, Literal) for x in value.args):
            raise TemplateError("var takes a literal name and a literal default")
        name = str(value.args[0].value)
        if name in variables:
            return variables[name]
        if len(value.args) == 2:
            return value.args[1].value
        raise TemplateError(f"unresolved var: {name}")
    raise TemplateError(f"not a literal: {value}")


def strings(call: Call, names: dict[str, Any], variables: dict[str, str], least: int, most: int) -> list[str]:
    found = [constant(x, names, variables) for x in call.args]
    if call.named or not least <= len(found) <= most or not all(isinstance(x, str) for x in found):
        raise TemplateError(f"unsupported dynamic {call.target.path}; only literal calls are supported")
    return found


def dispatch_of(call: Call) -> tuple[str, str | None]:
    """Name and namespace of ``adapter.dispatch``."""
    named = dict(call.named)
    if set(named) - {"macro_name", "macro_namespace"} or len(call.args) > 2:
        raise TemplateError("adapter.dispatch takes a macro name and a namespace")
    given = [constant(x, {}, {}) for x in call.args]
    name = given[0] if given else constant(named.get("macro_name", Literal(None)), {}, {})
    space = given[1] if len(given) > 1 else constant(named.get("macro_namespace", Literal(None)), {}, {})
    if not isinstance(name, str) or "." in name or not isinstance(space, str | None):
        raise TemplateError("adapter.dispatch takes a plain macro name")
    return name, space


def scan(text: str, variables: dict[str, str], params: tuple[str, ...] = ()) -> Found:
    """Everything that any branch of a template refers to."""
    found = Found()
    inside = bool(params)

    def value(x: Any, names: dict[str, Any]) -> None:
        if isinstance(x, Call):
            target = x.target
            if target == Name("ref"):
                got = strings(x, names, variables, 1, 2)
                add_once(found.refs, (got[0] if len(got) == 2 else None, got[-1]))
            elif target == Name("source"):
                add_once(found.sources, tuple(strings(x, names, variables, 2, 2)))
            elif target == Name("config"):
                if x.args:
                    raise TemplateError("config takes named arguments")
                found.config |= {k: constant(v, {}, {}) for k, v in x.named}
            elif target == Name("return"):
                for a in x.args:
                    value(a, names)
            elif isinstance(target, Call) and target.target == Name("adapter.dispatch"):
                add_once(found.dispatched, dispatch_of(target))
            elif isinstance(target, Name) and target.path not in _KNOWN:
                add_once(found.calls, target.path)
        elif isinstance(x, Compare):
            value(x.left, names)
            value(x.right, names)
        elif isinstance(x, Not):
            value(x.inner, names)

    def walk(nodes: list, names: dict[str, Any]) -> None:
        for node in nodes:
            if isinstance(node, Output):
                value(node.value, names)
            elif isinstance(node, SetList):
                names[node.name] = constant(node.value, names, variables)
            elif isinstance(node, For):
                for item in items_of(node, names) or [""]:
                    walk(node.body, names | {node.name: item})
            elif isinstance(node, If):
                for condition, body in node.arms:
                    if condition is not None:
                        value(condition, names)
                    walk(body, names)

    if not inside:
        walk(parse(text), {})
    else:  # a macro: its arguments are names without values
        walk(parse(text), {p: "" for p in params})
    return found


def items_of(node: For, names: dict[str, Any]) -> list[str]:
    items = names.get(node.items.path) if isinstance(node.items, Name) else constant(node.items, names, {})
    if not isinstance(items, list):
        raise TemplateError(f"the list of a loop is not known: {node.items}")
    return items


# rendering


class Renderer:
    """Gives the SQL of a template.

    ``relation`` renders refs (package, name) and ``source`` sources; ``macro`` finds a macro by its
    name, ``dispatch`` by an adapter.dispatch; ``context`` has this.* and target.* fields.
    """

    def __init__(self, variables: dict[str, str], relation: Callable, source: Callable, macro: Callable, dispatch: Callable, context: dict[str, str]):
        self.variables, self.relation, self.source, self.macro, self.dispatch, self.context = variables, relation, source, macro, dispatch, context

    def render(self, text: str) -> str:
        return self._walk(parse(text), {}, None, 0)

    def _walk(self, nodes: list, names: dict[str, Any], inside: Any, depth: int) -> str:
        """``inside`` is the macro whose body it is, None for a file."""
        out: list[str] = []
        for node in nodes:
            if isinstance(node, Text):
                out.append(node.text)
            elif isinstance(node, Output):
                out.append(self._value(node.value, names, inside, depth))
            elif inside is not None:
                raise TemplateError(f"macro {inside.name}: statements in macros are not supported")
            elif isinstance(node, SetList):
                names[node.name] = constant(node.value, names, self.variables)
            elif isinstance(node, For):
                items = items_of(node, names)
                if not items:
                    self._walk(node.body, names | {node.name: ""}, inside, depth)  # must be valid all the same
                out += [self._walk(node.body, names | {node.name: item}, inside, depth) for item in items]
            else:
                for condition, body in node.arms:
                    if condition is None or self._holds(condition, names):
                        out.append(self._walk(body, names, inside, depth))
                        break
        return "".join(out)

    def _operand(self, x: Any, names: dict[str, Any]) -> Any:
        if isinstance(x, Name):
            if x.path in names:
                return names[x.path]
            if x.path in self.context:
                return self.context[x.path]
            if x.path == "execute":
                return True
        if isinstance(x, Call) and x.target == Name("is_incremental") and not x.args and not x.named:
            return False
        return constant(x, names, self.variables)

    def _holds(self, x: Any, names: dict[str, Any]) -> bool:
        if isinstance(x, Not):
            return not self._holds(x.inner, names)
        if isinstance(x, Compare):
            left, right = self._operand(x.left, names), self._operand(x.right, names)
            if type(left) is not type(right) or not isinstance(left, str | bool):
                raise TemplateError("only strings or booleans can be compared")
            return (left == right) == (x.op == "==")
        value = self._operand(x, names)
        if not isinstance(value, bool):
            raise TemplateError("a condition has to be true or false")
        return value

    def _value(self, x: Any, names: dict[str, Any], inside: Any, depth: int) -> str:
        if isinstance(x, Name):
            if x.path in names:
                if isinstance(names[x.path], list):
                    raise TemplateError(f"a list can't be rendered: {x.path}")
                return str(names[x.path])
            if inside is None and x.path in self.context:
                return self.context[x.path]
            raise TemplateError(f"unsupported name: {x.path}")
        if not isinstance(x, Call):
            raise TemplateError(f"unsupported expression: {x}")
        target = x.target
        if isinstance(target, Call) and target.target == Name("adapter.dispatch"):
            return self._macro(self.dispatch(*dispatch_of(target), inside), x, names, depth)
        if target == Name("config") and inside is None:
            return ""
        if target == Name("return") and len(x.args) == 1 and not x.named:
            inner = x.args[0]
            return str(inner.value) if isinstance(inner, Literal) else self._value(inner, names, inside, depth)
        if target in (Name("ref"), Name("source")):
            if inside is not None:
                raise TemplateError(f"macro {inside.name}: ref and source in macros are not supported")
            if target == Name("ref"):
                got = strings(x, names, self.variables, 1, 2)
                return self.relation(got[0] if len(got) == 2 else None, got[-1])
            return self.source(*strings(x, names, self.variables, 2, 2))
        if isinstance(target, Name) and target.path not in _KNOWN:
            return self._macro(self.macro(target.path, inside), x, names, depth)
        raise TemplateError(f"unsupported call: {getattr(target, 'path', target)}")

    def _macro(self, macro: Any, call: Call, names: dict[str, Any], depth: int) -> str:
        if depth >= MOST_DEPTH:
            raise TemplateError(f"macros are nested over {MOST_DEPTH} deep at {macro.name}")
        if call.named or len(call.args) != len(macro.params):
            raise TemplateError(f"macro {macro.name} takes {len(macro.params)} positional arguments")
        given = []
        for x in call.args:
            if isinstance(x, Literal) and isinstance(x.value, str):
                given.append(x.value)
            elif isinstance(x, Name) and isinstance(names.get(x.path), str):
                given.append(names[x.path])
            else:
                raise TemplateError(f"macro {macro.name}: arguments are strings or bound names")
        return self._walk(parse(macro.body), dict(zip((p for p, _ in macro.params), given, strict=True)), macro, depth + 1)
