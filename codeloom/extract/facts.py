"""Facts of one source file: nodes, definitions, imports, uses, references, parameters, tokens and statements."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

from codeloom.extract import parsing, scopes

#: Symbol types as the index numbers them.
TYPE, FUNCTION, ASSIGNMENT, MODULE = range(4)
STATEMENTS = (ast.Assign, ast.Expr, ast.Import, ast.ImportFrom, ast.For, ast.FunctionDef)


def _name(node: ast.AST) -> str | None:
    for attr in ("name", "id", "arg", "attr"):
        if isinstance(v := getattr(node, attr, None), str):
            return v
    return None


def attribute_path(node: ast.Attribute) -> str | None:
    """'a.b.c' for the attributes of a plain name; null for those of other expressions."""
    parts: list[str] = []
    at: ast.expr = node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *parts[::-1]]) if isinstance(at, ast.Name) else None


def nodes(tree: ast.Module) -> Iterator[tuple]:
    """node_id, parent_id, depth, kind, name, complete_name, scope_id, is_expr, four positions, kinds of the nodes above from the top, attrs; in the order of the source.
    attrs has the plain fields, and path, the whole of a dotted name, at the attribute that ends it.
    A scope is the node of its module, class, function or lambda."""
    stack: list[tuple[ast.AST, int, tuple[str, ...], str, int]] = [(tree, -1, (), "", 0)]
    n = 0
    while stack:
        node, parent, above, outer, scope = stack.pop()
        me, name = n, _name(node)
        n += 1
        opens = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        complete = f"{outer}.{name}" if opens and outer else (name if opens else outer)
        attrs = {f: repr(v) for f, v in ast.iter_fields(node) if isinstance(v, (str, int, float, complex, bytes, bool)) and f not in ("lineno", "col_offset", "end_lineno", "end_col_offset")}
        if isinstance(node, ast.Attribute) and above[-1] != "Attribute" and (path := attribute_path(node)):
            attrs["path"] = path
        yield me, parent, len(above), type(node).__name__, name, complete or None, scope, isinstance(node, ast.expr), *parsing.span(node), list(above), attrs
        inner = me if opens or isinstance(node, (ast.Module, ast.Lambda)) else scope
        for child in reversed(list(ast.iter_child_nodes(node))):
            if not isinstance(child, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                stack.append((child, me, (*above, type(node).__name__), complete if opens else outer, inner))


def definitions(tree: ast.Module) -> Iterator[tuple]:
    """scope ('' for the module), name, symbol_type, line from 0; what classes, functions and the module define."""

    def walk(body, scope: str) -> Iterator[tuple]:
        for s in body:
            line = getattr(s, "lineno", 1) - 1
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield scope, s.name, TYPE if isinstance(s, ast.ClassDef) else FUNCTION, line
                yield from walk(s.body, f"{scope}.{s.name}" if scope else s.name)
            elif isinstance(s, ast.stmt):
                for x in sorted(scopes.bound(s)):
                    yield scope, x, ASSIGNMENT, line
                for c in scopes.children(s):
                    if isinstance(c, ast.stmt):
                        yield from walk([c], scope)
                    elif isinstance(c, (ast.ExceptHandler, ast.match_case)):
                        yield from walk(c.body, scope)

    yield from walk(tree.body, "")


def imports(tree: ast.Module) -> Iterator[tuple]:
    """kind (import, from), module, value, as_name, bound name, whether at the top level, first and last line from 0."""
    top = {id(s) for s in tree.body}
    for s in scopes.statements(tree.body):
        if isinstance(s, ast.Import):
            for a in s.names:
                yield "import", a.name, None, a.asname, a.asname or a.name.split(".")[0], id(s) in top, s.lineno - 1, s.end_lineno - 1
        elif isinstance(s, ast.ImportFrom):
            for a in s.names:
                yield "from", "." * s.level + (s.module or ""), a.name, a.asname, a.asname or a.name, id(s) in top, s.lineno - 1, s.end_lineno - 1


def uses(tree: ast.Module) -> Iterator[tuple]:
    """symbol, kind, attribute, argc, missing: names the module takes from outside when its imports are not read; missing if its
    imports do not give them either."""
    still = scopes.missing(tree)
    for name, how in sorted(scopes.missing(tree, strip_imports=True).items()):
        for u in sorted(how, key=lambda u: (u.kind, u.attribute, u.argc)):
            yield name, u.kind, u.attribute, u.argc, name in still


def parameters(tree: ast.Module) -> Iterator[tuple]:
    """function, position, name, kind (single, args, kwargs), hint, default; defaults belong to the last parameters."""

    def walk(node: ast.AST, outer: str) -> Iterator[tuple]:
        for c in ast.iter_child_nodes(node):
            named = isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            full = (f"{outer}.{c.name}" if outer else c.name) if named else outer
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = c.args
                plain = [*a.posonlyargs, *a.args]
                defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
                row = [(p, "single", d) for p, d in zip(plain, defaults, strict=True)]
                row += [(a.vararg, "args", None)] if a.vararg else []
                row += [(p, "single", d) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
                row += [(a.kwarg, "kwargs", None)] if a.kwarg else []
                for k, (p, kind, d) in enumerate(row):
                    yield full, k, p.arg, kind, ast.unparse(p.annotation) if p.annotation else None, ast.unparse(d) if d else None
            yield from walk(c, full)

    yield from walk(tree, "")


def references(tree: ast.Module) -> Iterator[tuple]:
    """name, resolved, context, line from 0: every name read, with the scope that defines it, looked up from the innermost scope
    outwards (class bodies are not seen from their methods), then the builtins; resolved is null for unknown names."""

    def own(node: ast.AST) -> set[str]:
        mine = scopes.defined(getattr(node, "body", []))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            mine |= {p.arg for p in scopes.parameters(node.args)}
        return mine

    # a stack of its own: yields through thousands of nested generators take time by the square of their number
    stack = [(ast.iter_child_nodes(tree), [("", own(tree), False)])]
    while stack:
        children, around = stack[-1]
        if (c := next(children, None)) is None:
            stack.pop()
            continue
        if isinstance(c, ast.Name) and isinstance(c.ctx, ast.Load):
            resolved = None
            for k, (scope, names, is_class) in enumerate(reversed(around)):
                if c.id in names and not (is_class and k):
                    resolved = f"{scope}.{c.id}" if scope else c.id
                    break
            else:
                resolved = f"builtins.{c.id}" if c.id in scopes.KNOWN else None
            yield c.id, resolved, around[-1][0], c.lineno - 1
        if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            full = f"{around[-1][0]}.{c.name}" if around[-1][0] else c.name
            around = [*around, (full, own(c), isinstance(c, ast.ClassDef))]
        elif isinstance(c, ast.Lambda):
            around = [*around, (around[-1][0], {p.arg for p in scopes.parameters(c.args)}, False)]
        elif isinstance(c, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            bound = set().union(*(scopes.targets(g.target) for g in c.generators))
            around = [*around, (around[-1][0], bound, False)]
        stack.append((ast.iter_child_nodes(c), around))


def name_tokens(source: str) -> list[str]:
    """All NAME tokens; of a source the tokenizer gives up on, those before."""
    out: list[str] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.NAME:
                out.append(t.string)
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return out


def statements(tree: ast.Module) -> Iterator[tuple]:
    """kind, line from 0, and the statement's text in one normal form."""
    for s in scopes.statements(tree.body):
        if isinstance(s, STATEMENTS):
            yield type(s).__name__, s.lineno - 1, ast.unparse(s)
