"""Wildcards of selectors: ``*``, ``?``, ``[a-z]``, ``[!x]``."""

from __future__ import annotations

import re
from functools import lru_cache


@lru_cache(1024)
def compiled(pattern: str, across: bool) -> re.Pattern[str]:
    """``across`` lets * and ? match a slash."""
    out, i = "", 0
    any_one = "." if across else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.find("]", i + 3 if pattern[i + 1 : i + 2] == "!" else i + 2)
            if end > 0:
                inner = pattern[i + 1 : end]
                inverted, inner = inner.startswith("!"), inner.removeprefix("!")
                out += f"[{'^' if inverted else ''}{re.sub(r'([]\\^[])', r'\\\1', inner)}]"
                i = end + 1
                continue
        out += any_one + "*" if c == "*" else any_one if c == "?" else re.escape(c)
        i += 1
    return re.compile(out, re.S)


def is_wild(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def match(pattern: str, text: str, across: bool = True) -> bool:
    return bool(compiled(pattern, across).fullmatch(text)) if is_wild(pattern) else pattern == text
