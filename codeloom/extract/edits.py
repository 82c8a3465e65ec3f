"""Edits of one text, and the edits that change its imports.

An edit is (kind, start line, start column, end line, end column, text) with kind replace, insert or delete, positions from 0
before any edit; a negative column counts from the end of its line.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable
from typing import NamedTuple


class Edit(NamedTuple):
    kind: str
    line: int
    col: int
    end_line: int
    end_col: int
    text: str


def insert(line: int, col: int, text: str) -> Edit:
    return Edit("insert", line, col, line, col, text)


class Conflict(ValueError):
    """Two edits touch the same text."""


def _offsets(text: str) -> list[int]:
    out = [0]
    for line in text.splitlines(keepends=True):
        out.append(out[-1] + len(line))
    return out


def _at(starts: list[int], text: str, line: int, col: int) -> int:
    if line >= len(starts) - 1:
        return starts[-1]
    end = starts[line + 1]
    while end > starts[line] and text[end - 1] in "\r\n":
        end -= 1
    return max(starts[line], end + col + 1) if col < 0 else min(starts[line] + col, starts[line + 1])


def spans(text: str, edits: Iterable[Edit]) -> list[tuple[int, int, int, str]]:
    """(from, to, number, new text) by place; raises Conflict where replacements or deletions overlap or hold an insertion."""
    starts = _offsets(text)
    out = []
    for n, e in enumerate(edits):
        lo = _at(starts, text, e.line, e.col)
        hi = lo if e.kind == "insert" else _at(starts, text, e.end_line, e.end_col)
        out.append((lo, max(lo, hi), n, "" if e.kind == "delete" else e.text))
    out.sort(key=lambda x: (x[0], x[1], x[2]))
    reach = -1
    for lo, hi, _, _ in out:
        if lo < reach:
            raise Conflict(f"edits overlap at character {lo}")
        reach = max(reach, hi)
    return out


def apply(text: str, edits: Iterable[Edit]) -> str:
    """The text with all edits made, from the end to the beginning; insertions at one place keep their order."""
    for lo, hi, _, new in reversed(spans(text, edits)):
        text = text[:lo] + new + text[hi:]
    return text


# --- imports ------------------------------------------------------------------------------------------------------


class Wanted(NamedTuple):
    module: str
    value: str | None = None
    as_name: str | None = None


def named(value: str, as_name: str | None) -> str:
    return f"{value} as {as_name}" if as_name else value


def statement(module: str, values: Iterable[tuple[str, str | None]]) -> str:
    names = ", ".join(named(v, a) for v, a in sorted(set(values), key=lambda x: (x[0], x[1] or "")))
    return f"from {module} import {f'({names})' if ',' in names else names}"


def _module(s: ast.ImportFrom) -> str:
    return "." * s.level + (s.module or "")


def import_edits(tree: ast.Module, add: Iterable[Wanted], remove: Iterable[str]) -> list[Edit]:
    """Edits that add imports and take away the top-level ones that bind the names in remove ('*': all star imports).

    A wanted value joins the first from-import of its module. Other new imports go before the first import of their kind whose
    module sorts after theirs, else behind the last one, else behind the docstring or to the top. A statement of which
    some names go is rewritten with its names sorted; one of which all go is deleted with its lines."""
    gone, edits = set(remove), []
    top = [s for s in tree.body if isinstance(s, (ast.Import, ast.ImportFrom))]
    joined: dict[int, list[tuple[str, str | None]]] = {}
    rest: list[Wanted] = []
    for w in sorted(set(add), key=lambda w: (w.module, w.value or "", w.as_name or "")):
        home = next((s for s in top if isinstance(s, ast.ImportFrom) and _module(s) == w.module and s.names[0].name != "*"), None) if w.value else None
        if home is None:
            rest.append(w)
        else:
            joined.setdefault(id(home), []).append((w.value, w.as_name))
    for s in top:
        bound = [(a, a.asname or (a.name.split(".")[0] if isinstance(s, ast.Import) else a.name)) for a in s.names]
        keep, new = [(a.name, a.asname) for a, b in bound if b not in gone], joined.get(id(s), [])
        if len(keep) == len(bound) and not new:
            continue
        if not keep and not new:
            edits.append(Edit("delete", s.lineno - 1, 0, s.end_lineno, 0, ""))
            continue
        text = statement(_module(s), [*keep, *new]) if isinstance(s, ast.ImportFrom) else "import " + ", ".join(named(v, a) for v, a in sorted(keep))
        edits.append(Edit("replace", s.lineno - 1, s.col_offset, s.end_lineno - 1, s.end_col_offset, text))

    doc = tree.body[0] if tree.body and isinstance(tree.body[0], ast.Expr) and isinstance(tree.body[0].value, ast.Constant) and isinstance(tree.body[0].value.value, str) else None
    start = doc.end_lineno if doc else 0
    start = max([start, *(s.end_lineno for s in top if isinstance(s, ast.ImportFrom) and s.module == "__future__")])
    by_module: dict[str, list[tuple[str, str | None]]] = {}
    for w in rest:
        if w.value:
            by_module.setdefault(w.module, []).append((w.value, w.as_name))
    lines = [("import", w.module, f"import {named(w.module, w.as_name)}") for w in rest if not w.value]
    lines += [("from", m, statement(m, v)) for m, v in sorted(by_module.items())]
    for kind, module, text in lines:
        if kind == "import":
            own = [(a.name, s) for s in top if isinstance(s, ast.Import) for a in s.names[:1]]
        else:
            own = [(_module(s), s) for s in top if isinstance(s, ast.ImportFrom) and s.module != "__future__"]
        later = [s for m, s in sorted(own, key=lambda x: (x[0], x[1].lineno)) if m > module]
        if later:
            line = later[0].lineno - 1
        else:
            line = max([start, *(s.end_lineno for _, s in own or [("", s) for s in top])])
        edits.append(insert(line, 0, text + "\n"))
    return edits
