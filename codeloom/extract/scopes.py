"""Which names a piece of code takes from outside, and which it defines.

Scoping does not depend on order: a name defined anywhere in a block hides its uses in that block. A use is kept with
how the name is used: raw, call (number of arguments), subscript or attribute.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: Names every module has, and builtins of the second language version; fixed values.
MODULE_NAMES = ("__package__", "__name__", "__path__", "__file__", "__loader__", "__builtins__", "__builtin__", "__doc__", "__spec__", "__annotations__")
OLD_BUILTINS = ("intern", "unichr", "StandardError", "reduce", "exit", "reload", "file", "execfile", "basestring", "long", "apply", "quit", "coerce", "raw_input", "cmp", "xrange", "unicode", "buffer")
KNOWN = frozenset(dir(builtins)) | frozenset(MODULE_NAMES) | frozenset(OLD_BUILTINS)


@dataclass(frozen=True)
class Use:
    kind: str  # raw, call, subscript, attribute
    attribute: str = ""
    argc: int = 0


Uses = dict[str, set[Use]]
_RAW = Use("raw")


def merge(*parts: Uses) -> Uses:
    """The uses of all parts; parts are never changed, so what one part has alone is shared with the result."""
    some = [p for p in parts if p]
    if len(some) == 1:
        return some[0]
    out: Uses = {}
    for p in some:
        for name, uses in p.items():
            out[name] = out[name] | uses if name in out else uses
    return out


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes directly beneath a node, as ast.iter_child_nodes gives them, in one list."""
    out: list[ast.AST] = []
    for f in node._fields:
        v = getattr(node, f, None)
        if isinstance(v, list):
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def statements(body: Iterable[ast.stmt]) -> Iterator[ast.stmt]:
    """Every statement of a block and of the blocks in it, in the order of the source."""
    todo = list(body)[::-1]
    while todo:
        s = todo.pop()
        yield s
        inside = [x for part in ("body", "handlers", "cases", "orelse", "finalbody") for x in getattr(s, part, ())]
        flat = [y for x in inside for y in (x.body if isinstance(x, (ast.ExceptHandler, ast.match_case)) else [x])]
        todo += flat[::-1]


def less(uses: Uses, names: Iterable[str]) -> Uses:
    hidden = set(names)
    return {k: v for k, v in uses.items() if k not in hidden}


@dataclass
class Flow:
    uses: Uses = field(default_factory=dict)
    defs: set[str] = field(default_factory=set)


def targets(node: ast.AST | None) -> set[str]:
    """Every name that is free in what is assigned to; a.b = 1 and a[i] = 1 count a (and i) as well."""
    if isinstance(node, ast.Name):
        return {node.id}
    return set() if node is None else {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


def parameters(a: ast.arguments) -> list[ast.arg]:
    return [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]


class Scoper:
    """strip_imports: read the code as if its import statements were not there."""

    def __init__(self, strip_imports: bool = False):
        self.strip_imports = strip_imports
        self.named: list[str] = []  # names bound by := in what was read of the current block

    # --- expressions (lists where map or a generator would do: those recurse on the C stack, whose depth is fixed)

    def expr(self, node: ast.AST | None) -> Uses:
        if node is None or isinstance(node, ast.Constant):
            return {}
        if isinstance(node, ast.Name):
            return {node.id: {_RAW}}
        if isinstance(node, ast.Attribute):
            return self._on(node.value, Use("attribute", node.attr))
        if isinstance(node, ast.Call):
            argc = len(node.args) + len(node.keywords)
            return merge(self._on(node.func, Use("call", argc=argc)), *[self.expr(a) for a in node.args], *[self.expr(k.value) for k in node.keywords])
        if isinstance(node, ast.Subscript):
            return merge(self._on(node.value, Use("subscript")), self.expr(node.slice))
        if isinstance(node, ast.Lambda):
            a, before = node.args, len(self.named)
            body = less(self.expr(node.body), (p.arg for p in parameters(a)))
            del self.named[before:]
            return merge(body, *[self.expr(d) for d in (*a.defaults, *a.kw_defaults)])
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            bound = set().union(*(targets(g.target) for g in node.generators))
            inner = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            for g in node.generators:
                inner += [g.iter, *g.ifs]
            return less(merge(*[self.expr(x) for x in inner]), bound)
        if isinstance(node, ast.NamedExpr):
            self.named.append(node.target.id)
            return self.expr(node.value)
        return merge(*[self.expr(c) for c in children(node)])

    def _on(self, base: ast.AST, use: Use) -> Uses:
        return {base.id: {use}} if isinstance(base, ast.Name) else self.expr(base)

    # --- statements

    def group(self, body: Iterable[ast.stmt]) -> Flow:
        parts = [self.stmt(s) for s in body]
        defs = set().union(*(p.defs for p in parts)) if parts else set()
        return Flow(less(merge(*(p.uses for p in parts)), defs), defs)

    def stmt(self, s: ast.stmt) -> Flow:
        before = len(self.named)
        made = getattr(self, f"_{type(s).__name__.lower()}", None)
        if made:
            f = made(s)
        else:  # an expression, return, raise, assert, delete or the like
            f = Flow(merge(*map(self.expr, children(s))))
        if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            f.defs.update(self.named[before:])
        del self.named[before:]
        return f

    def _assign(self, s):
        return Flow(self.expr(s.value), set().union(*map(targets, s.targets)))

    def _augassign(self, s):
        return Flow(merge(self.expr(s.value), self.expr(s.target)), targets(s.target))

    def _annassign(self, s):
        return Flow(merge(self.expr(s.annotation), self.expr(s.value)), targets(s.target))

    def _typealias(self, s):
        return Flow(less(self.expr(s.value), (p.name for p in s.type_params)), targets(s.name))

    def _for(self, s):
        bound = targets(s.target)
        inner = self.group([*s.body, *s.orelse])
        return Flow(merge(less(inner.uses, bound), self.expr(s.iter)), bound | inner.defs)

    _asyncfor = _for

    def _while(self, s):
        inner = self.group([*s.body, *s.orelse])
        return Flow(merge(inner.uses, self.expr(s.test)), inner.defs)

    def _if(self, s):
        a, b = self.group(s.body), self.group(s.orelse)
        return Flow(merge(a.uses, b.uses, self.expr(s.test)), a.defs | b.defs)

    def _with(self, s):
        bound = set().union(*(targets(i.optional_vars) for i in s.items))
        inner = self.group(s.body)
        return Flow(merge(less(inner.uses, bound), *(self.expr(i.context_expr) for i in s.items)), bound | inner.defs)

    _asyncwith = _with

    def _try(self, s):
        parts = [self.group(x) for x in (s.body, s.orelse, s.finalbody)] + [self._handler(h) for h in s.handlers]
        return Flow(merge(*(p.uses for p in parts)), set().union(*(p.defs for p in parts)))

    _trystar = _try

    def _handler(self, h):
        inner = self.group(h.body)
        return Flow(less(merge(inner.uses, self.expr(h.type)), [h.name] if h.name else []), inner.defs)

    def _match(self, s):
        flow = Flow(self.expr(s.subject))
        for c in s.cases:
            bound = captures(c.pattern)
            inner = self.group(c.body)
            flow.uses = merge(flow.uses, less(merge(inner.uses, self.expr(c.guard), self.expr(c.pattern)), bound))
            flow.defs |= bound | inner.defs
        return flow

    def _classdef(self, s):
        inside = [self.stmt(x) for x in s.body]
        defs = set().union(*(p.defs for p in inside)) if inside else set()
        plain = merge(*(p.uses for x, p in zip(s.body, inside, strict=True) if not _is_function(x)))
        methods = merge(*(p.uses for x, p in zip(s.body, inside, strict=True) if _is_function(x)))  # class names do not hide these
        generic = [p.name for p in s.type_params]
        around = merge(*map(self.expr, s.bases), *(self.expr(k.value) for k in s.keywords))
        return Flow(merge(less(merge(less(plain, defs), methods, around), generic), *map(self.expr, s.decorator_list)), {s.name})

    def _functiondef(self, s):
        own = {p.arg for p in parameters(s.args)} | {p.name for p in s.type_params}
        hints = [p.annotation for p in parameters(s.args)] + [s.returns]
        signature = less(merge(*map(self.expr, hints)), (p.name for p in s.type_params))
        outside = [*s.args.defaults, *s.args.kw_defaults, *s.decorator_list]
        return Flow(merge(less(self.group(s.body).uses, own), signature, *map(self.expr, outside)), {s.name})

    _asyncfunctiondef = _functiondef

    def _import(self, s):
        return Flow() if self.strip_imports else Flow({}, {a.asname or a.name.split(".")[0] for a in s.names})

    def _importfrom(self, s):
        return Flow() if self.strip_imports else Flow({}, {a.asname or a.name for a in s.names})

    def _global(self, s):
        return Flow()

    _nonlocal = _pass = _break = _continue = _global


def bound(s: ast.stmt) -> set[str]:
    """Names a statement itself assigns, without those of the blocks in it; imports, functions and classes assign none here."""
    if isinstance(s, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return set()
    if isinstance(s, ast.Assign):
        names = set().union(*map(targets, s.targets))
    elif isinstance(s, (ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor)):
        names = targets(s.target)
    elif isinstance(s, ast.TypeAlias):
        names = targets(s.name)
    elif isinstance(s, (ast.With, ast.AsyncWith)):
        names = set().union(*(targets(i.optional_vars) for i in s.items))
    elif isinstance(s, ast.Match):
        names = set().union(*(captures(c.pattern) for c in s.cases))
    else:
        names = set()
    return names.union(*(_walrus(c) for c in children(s) if isinstance(c, ast.expr)))


def captures(pattern: ast.pattern) -> set[str]:
    found = list(ast.walk(pattern))
    return {n.name for n in found if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name} | {n.rest for n in found if isinstance(n, ast.MatchMapping) and n.rest}


def _walrus(node: ast.AST | None) -> set[str]:
    """Names bound by := in an expression, outside of lambdas."""
    out, todo = set(), [node]
    while todo:
        n = todo.pop()
        if n is None or isinstance(n, (ast.Name, ast.Constant, ast.Lambda, ast.stmt)):
            continue
        if isinstance(n, ast.NamedExpr):
            out.add(n.target.id)
        todo += children(n)
    return out


def _is_function(s: ast.AST) -> bool:
    return isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef))


def missing(tree: ast.Module, strip_imports: bool = False, known: frozenset[str] = KNOWN) -> Uses:
    """Names the module uses but neither defines nor can take from the builtins."""
    return less(Scoper(strip_imports).group(tree.body).uses, known)


def exports(tree: ast.Module) -> set[str]:
    """What a star import takes: __all__ where it is a list of strings, else the names without an underscore in front."""
    for s in tree.body:
        if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) and isinstance(s.value, (ast.List, ast.Tuple)):
            return {e.value for e in s.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return {d for d in defined(tree.body) if not d.startswith("_") and d != "*"}


def defined(body: Iterable[ast.stmt]) -> set[str]:
    """The names a block defines: Scoper.group(body).defs, found without looking at uses."""
    out: set[str] = set()
    for s in body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(s.name)
        elif isinstance(s, ast.Import):
            out.update(a.asname or a.name.split(".")[0] for a in s.names)
        elif isinstance(s, ast.ImportFrom):
            out.update(a.asname or a.name for a in s.names)
        else:
            out |= bound(s)
            for part in ("body", "orelse", "finalbody"):
                out |= defined(getattr(s, part, ()))
            for h in (*getattr(s, "handlers", ()), *getattr(s, "cases", ())):
                out |= defined(h.body)
    return out


def closures(tree: ast.Module) -> Iterator[tuple[str, str, str]]:
    """(dotted function, name, dotted function around it) for the names a function takes from the functions around it; classes between
    two functions hold no names for the inner one."""
    scoper = Scoper()

    def walk(body: Iterable[ast.AST], name: str, around: set[str], outer: str | None) -> Iterator[tuple[str, str, str]]:
        for s in body:
            if _is_function(s):
                full = f"{name}.{s.name}" if name else s.name
                if outer is not None:
                    own = {p.arg for p in parameters(s.args)}
                    for x in sorted(set(less(scoper.group(s.body).uses, own)) & around):
                        yield full, x, outer
                mine = {p.arg for p in parameters(s.args)} | defined(s.body)
                yield from walk(s.body, full, around | mine, full)
            elif isinstance(s, ast.ClassDef):
                yield from walk(s.body, f"{name}.{s.name}" if name else s.name, around, outer)
            else:
                yield from walk(ast.iter_child_nodes(s), name, around, outer)

    yield from walk(tree.body, "", set(), None)
