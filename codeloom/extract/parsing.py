"""Parsing that survives broken code: what cannot be parsed is left out, the rest keeps its positions."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

#: So many starts after a statement's own are tried as its end before quotes and brackets are looked at.
NEAR = 8

_MARK = re.compile(r"\"{3}|'{3}|[\"'#()\[\]{}]|\\.", re.DOTALL)
_CLOSE = {q: re.compile(rf"(?:[^\\{q[0]}]|\\.|{q[0]}(?!{q[0] * 2}))*?{q}" if len(q) == 3 else rf"(?:[^\\{q}]|\\.)*{q}", re.DOTALL) for q in ('"', "'", '"' * 3, "'" * 3)}
_JOINED = re.compile(r"\\\r?\n?$")
#: Lines that do not stand in brackets.
_STATEMENT = re.compile(r"(?:def|class|import|while|with|try|return|raise|pass|del|global|nonlocal|assert)\b")


def parse(source: str) -> tuple[ast.Module | None, str | None]:
    """The tree, and the error of a source that does not parse as a whole."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source), None
        except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
            return None, f"{type(e).__name__}: {e}"


def parse_tolerant(source: str) -> tuple[ast.Module, list[tuple[int, int]], str | None]:
    """The tree of all top-level statements that parse, the 1-based line ranges left out, and the first error.

    A statement begins at a line that is not indented and no continuation; the next few are tried together with it (decorators,
    else branches, open brackets), then all up to where quotes, brackets and clauses say that it ends."""
    tree, error = parse(source)
    if tree is not None:
        return tree, [], None
    lines = source.splitlines(keepends=True)
    starts = [n for n, line in enumerate(lines) if line.strip() and not line[0].isspace() and not line.startswith(("#", ")", "]", "}"))] or [0]
    starts.append(len(lines))
    body: list[ast.stmt] = []
    bad: list[tuple[int, int]] = []
    at = 0
    while at < len(starts) - 1:
        for upto in _ends(lines, starts, at):
            part, _ = parse("\n" * starts[at] + "".join(lines[starts[at] : starts[upto]]))
            if part is not None and not _goes_on(lines, starts, upto):
                body += part.body
                at = upto
                break
        else:
            bad.append((starts[at] + 1, starts[at + 1]))
            at += 1
    return ast.Module(body=body, type_ignores=[]), bad, error


def _ends(lines: list[str], starts: list[int], at: int) -> Iterator[int]:
    """Starts before which the statement that begins at one may end: the next few, and where it ends by its quotes and brackets if
    that is further. Most statements end soon; the few are there for text that is not read right without a parser."""
    near = min(at + NEAR, len(starts) - 1)
    yield from range(at + 1, near + 1)
    quote, depth, upto, head = "", 0, at, at
    while upto < len(starts) - 1:
        if depth > 0 and not quote and _STATEMENT.match(lines[starts[upto]]):
            return  # a bracket that is never closed
        for line in lines[starts[upto] : starts[upto + 1]]:
            quote, depth = _open_after(line, quote, depth)
        upto += 1
        if quote or depth > 0 or _joined(lines, starts, upto):
            continue
        if not lines[starts[head]].startswith("@") and not _goes_on(lines, starts, upto):
            break
        head = upto
    if upto > near:
        yield upto


def _open_after(line: str, quote: str, depth: int) -> tuple[str, int]:
    """The quote that is open after a line, and the number of brackets that are."""
    at = 0
    while at < len(line):
        if quote:
            m = _CLOSE[quote].match(line, at)
            if m is None:  # strings in single quotes end with their line unless it is joined to the next
                return quote if len(quote) == 3 or _JOINED.search(line) else "", depth
            quote, at = "", m.end()
        elif (m := _MARK.search(line, at)) is None or m[0] == "#":
            break
        else:
            at = m.end()
            if m[0][0] in "\"'":
                quote = m[0]
            elif m[0][0] != "\\":
                depth += 1 if m[0] in "([{" else -1
    return quote, depth


def _joined(lines: list[str], starts: list[int], at: int) -> bool:
    return at < len(starts) - 1 and starts[at] > 0 and _JOINED.search(lines[starts[at] - 1]) is not None


def _goes_on(lines: list[str], starts: list[int], at: int) -> bool:
    return at < len(starts) - 1 and lines[starts[at]].split(None, 1)[0].rstrip(":") in ("else", "elif", "except", "finally")


def span(node: ast.AST) -> tuple[int, int, int, int]:
    """First line, column, last line, column; all from 0."""
    if not hasattr(node, "lineno"):
        return 0, 0, 0, 0
    return node.lineno - 1, node.col_offset, (node.end_lineno or node.lineno) - 1, node.end_col_offset or node.col_offset
