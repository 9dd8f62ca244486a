"""Names and ids of generic tests, as artifacts of other tools spell them."""

from __future__ import annotations

import hashlib
import re

from weftline.model import TestSpec

BUILT_IN = ("not_null", "unique", "accepted_values", "relationships")

#: a name of this many characters or more gets a short alias
LONGEST = 63


def clean(text: str) -> str:
    """Runs of anything but letters, digits and _ become one _."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", text)


def test_names(spec: TestSpec, of: str, column: str | None, prefix: str = "") -> tuple[str, str]:
    """Full name and alias of a test of ``of``; ``prefix`` is ``source_`` for tests of sources."""
    parts = [clean(column)] if column is not None else []
    if spec.name == "relationships":
        parts += [clean(spec.field), clean(spec.to)]
    elif spec.name == "accepted_values":
        if spec.quote is not None:
            parts.append(str(spec.quote))
        parts += [clean(v) for v in spec.values]
    head = f"{spec.namespace + '_' if spec.namespace else ''}{prefix}{spec.name}_{of}"
    full = f"{head}_{'__'.join(parts)}"
    if len(full) <= LONGEST:
        return full, full
    return full, f"{head[:30]}_{hashlib.md5(full.encode()).hexdigest()}"  # noqa: S324


def test_id(package: str, name: str, spec: TestSpec, model: str, column: str | None, of_source: bool = False) -> str:
    """The unique id; its end is the hash of the name and of the test's arguments.

    Built-in tests of sources are hashed under a name of their own and without further arguments.
    """
    called = f"source_{spec.name}" if of_source and spec.name in BUILT_IN else spec.name
    given: dict[str, str] = {"model": f'"{model}"'}
    if column is not None:
        given["column_name"] = f"'{column}'"
        if called == "accepted_values":
            given["values"] = repr(list(spec.values))
            if spec.quote is not None:
                given["quote"] = f"'{spec.quote}'"
        elif called == "relationships":
            given["field"], given["to"] = f"'{spec.field}'", f'"{spec.to}"'
    kwargs = ", ".join(f"'{k}': {v}" for k, v in sorted(given.items()))
    text = f"{name}{{'kwargs': {{{kwargs}}}, 'name': '{called}', 'namespace': '{spec.namespace or None}'}}"
    return f"test.{package}.{name}.{hashlib.md5(text.encode()).hexdigest()[-10:]}"  # noqa: S324


def model_argument(of: str) -> str:
    return f"{{{{ get_where_subquery({of}) }}}}"
