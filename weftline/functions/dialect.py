"""A shim from DuckDB-flavoured SQL to Spark SQL, by tokens: strings and comments are left alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:''|[^'])*')|(?P<ident>"(?:""|[^"])*")|(?P<word>[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign>::|.)""", re.S)

#: fixed values: type names of the other dialect and Spark's
TYPES = {"varchar": "string", "text": "string", "hugeint": "decimal(38,0)", "int8": "bigint", "int4": "int", "int2": "smallint", "float8": "double", "float4": "float", "bool": "boolean", "timestamptz": "timestamp", "datetime": "timestamp_ntz", "blob": "binary"}
#: fixed values: functions whose names differ only
FUNCTIONS = {"epoch_ms": "unix_millis", "list_contains": "array_contains", "list_value": "array", "string_split": "split", "strlen": "octet_length", "array_length": "size", "list_sort": "sort_array", "regexp_matches": "regexp_like", "arg_min": "min_by", "arg_max": "max_by"}
#: fixed values: strftime's codes and Spark's patterns
DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%p": "a", "%I": "hh", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE"}


@dataclass
class Token:
    kind: str
    text: str


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup or "sign", m[0]) for m in _TOKEN.finditer(sql)]


def date_pattern(codes: str) -> str:
    """Spark's pattern for a format of strftime."""
    out = ""
    for part in re.findall(r"%.|[^%]+", codes):
        out += DATE_CODES.get(part) or ("'" + part.replace("'", "''") + "'" if re.search("[A-Za-z']", part) else part)
    return out


def to_spark(sql: str) -> str:
    """The statement in Spark's SQL."""
    found = tokens(sql)
    solid = [i for i, t in enumerate(found) if t.kind != "space"]
    for n, i in enumerate(solid):
        t = found[i]
        low = t.text.lower()
        after = found[solid[n + 1]].text if n + 1 < len(solid) else ""
        before = found[solid[n - 1]].text.lower() if n else ""
        if t.kind != "word":
            continue
        if low in TYPES and _is_type(found, solid, n, before):
            t.text = t.text if after == "(" else TYPES[low]  # varchar(10) is fine as it is
        elif after == "(" and low in FUNCTIONS:
            t.text = FUNCTIONS[low]
        elif after == "(" and low == "epoch":
            _epoch(found, solid, n)
        elif after == "(" and low == "strftime":
            _strftime(found, solid, n)
        elif low == "exclude" and before == "*" and after == "(":
            t.text = "except"
    return _qualify("".join(t.text for t in found))


def _is_type(found: list[Token], solid: list[int], n: int, before: str) -> bool:
    """Whether a word stands where a type does: behind ``::``, or behind ``as`` inside a cast."""
    if before == "::":
        return True
    if before != "as":
        return False
    depth = 0
    for k in range(n - 1, 0, -1):
        text = found[solid[k]].text
        depth += (text == ")") - (text == "(")
        if depth < 0:
            return found[solid[k - 1]].text.lower() in ("cast", "try_cast")
    return False


def _close(found: list[Token], solid: list[int], n: int) -> int:
    """Place in ``solid`` of the bracket that closes the one behind place n."""
    depth = 0
    for k in range(n + 1, len(solid)):
        text = found[solid[k]].text
        depth += (text == "(") - (text == ")")
        if not depth:
            return k
    return len(solid) - 1


def _epoch(found: list[Token], solid: list[int], n: int) -> None:
    """Seconds with their fraction."""
    end = found[solid[_close(found, solid, n)]]
    found[solid[n]].text = "(unix_micros"
    found[solid[n + 1]].text = "(cast("
    end.text = " as timestamp)) / 1e6d)"


def _strftime(found: list[Token], solid: list[int], n: int) -> None:
    last = _close(found, solid, n)
    code = found[solid[last - 1]]
    if code.kind == "string":
        code.text = "'" + date_pattern(code.text[1:-1].replace("''", "'")).replace("'", "\\'") + "'"
        found[solid[n]].text = "date_format"


def _qualify(sql: str) -> str:
    """``select ... qualify c`` at the top level becomes a filter over a subquery."""
    found = tokens(sql)
    depth, at, start = 0, None, 0
    for i, t in enumerate(found):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.kind == "word" and t.text.lower() == "select" and at is None:
            start = i
        if not depth and t.kind == "word" and t.text.lower() == "qualify":
            at = i
    if at is None:
        return sql
    stop = next((i for i in range(at + 1, len(found)) if found[i].kind == "word" and found[i].text.lower() in ("order", "limit") and _level(found, at, i) == 0), len(found))
    text = lambda part: "".join(t.text for t in part)
    condition = text(found[at + 1 : stop]).strip()
    head, body = text(found[:start]), text(found[start:at]).rstrip()
    inner = re.sub(r"^select\b", f"select ({condition}) as __qualified, ", body, count=1, flags=re.I)
    return f"{head}select * except (__qualified) from ({inner}) where __qualified {text(found[stop:])}"


def _level(found: list[Token], a: int, b: int) -> int:
    return sum((t.text == "(") - (t.text == ")") for t in found[a:b])


def trim_terminator(sql: str) -> str:
    """Without the final ``;`` and the comments behind it; without a ``;`` comments are kept."""
    found = tokens(sql)
    k = len(found)
    while k and found[k - 1].kind == "space":
        k -= 1
    if k and found[k - 1].text == ";":
        return "".join(t.text for t in found[: k - 1]).rstrip()
    return sql.rstrip()


def inject_ctes(sql: str, ctes: list[tuple[str, str]]) -> str:
    """The statement with common table expressions in front of its own."""
    if not ctes:
        return sql
    made = ", ".join(f"{name} as (\n{body}\n)" for name, body in ctes)
    found = tokens(sql)
    k = next((i for i, t in enumerate(found) if t.kind != "space"), len(found))
    lead, rest = "".join(t.text for t in found[:k]), found[k:]
    if rest and rest[0].text.lower() == "with":
        after = next((i for i in range(1, len(rest)) if rest[i].kind != "space"), 1)
        word = "with"
        if rest[after].text.lower() == "recursive":
            word, after = "with recursive", next((i for i in range(after + 1, len(rest)) if rest[i].kind != "space"), after + 1)
        return f"{lead}{word} {made}, {''.join(t.text for t in rest[after:])}"
    return f"{lead}with {made}\n{''.join(t.text for t in rest)}"
