"""What the names of a module may evaluate to, without running it.

Every branch of an if and every suite of a try is taken, a loop body once; a name assigned on several ways may have several
values. What is not known is unknown: calls of things that are not defined here, operators on unknowns, reads that fail.
"""

from __future__ import annotations

import ast
import itertools
from dataclasses import dataclass, field
from typing import Any

from codeloom.extract import scopes

#: An operation is worked out for at most this many combinations of its operands' values; with more of them MORE is added.
MAX_COMBINATIONS = 256
#: A call nested deeper is not followed: it may give anything, UNKNOWN and MORE.
MAX_DEPTH = 24
MAX_SIZE = 10_000


@dataclass(eq=False)
class Value:
    kind: str  # unknown, native, function, class, instance, module
    value: Any = None
    name: str | None = None
    members: dict[str, list[Value]] = field(default_factory=dict)

    def type_name(self) -> str | None:
        if self.kind == "native":
            return type(self.value).__name__
        return {"function": "function", "class": "type", "instance": self.name, "module": "module"}.get(self.kind)

    def text(self) -> str | None:
        return (repr(self.value) if self.kind == "native" else self.name) if self.kind != "unknown" else None

    def key(self) -> tuple:
        return (self.kind, self.type_name(), repr(self.value)) if self.kind == "native" else (self.kind, self.name if self.kind == "unknown" else id(self))


Values = list[Value]
UNKNOWN = Value("unknown")
#: Stands for values that a limit left out. It never comes alone, so what holds it is ambiguous.
MORE = Value("unknown", None, "...")


def native(x: Any) -> Value:
    return Value("native", x)


def union(*parts: Values) -> Values:
    out: dict[tuple, Value] = {}
    for p in parts:
        for v in p:
            out.setdefault(v.key(), v)
    return list(out.values())


def truth(v: Value) -> bool | None:
    if v.kind == "native":
        return bool(v.value)
    return None if v.kind in ("unknown", "instance") else True


def fuzzy(values: list[bool | None]) -> bool | None:
    """TRUE if all are, MAYBE (None) if any is true or maybe, else FALSE."""
    if values and all(v is True for v in values):
        return True
    return None if any(v is not False for v in values) else False


def instance_of(values: Values, type_name: str) -> bool | None:
    return fuzzy([None if v.type_name() is None else v.type_name() == type_name for v in values])


_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b,
    ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a ^ b,
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b,
}
_PLAIN = (int, float, complex, str, bytes, bool, type(None), list, tuple, dict, set, type(...))


def _small(x: Any) -> bool:
    """Results stay small: no number or collection grows without bound."""
    if isinstance(x, int):
        return x.bit_length() < 4096
    return not hasattr(x, "__len__") or len(x) <= MAX_SIZE


class Frame:
    def __init__(self, back: Frame | None = None, is_class: bool = False):
        self.names: dict[str, Values] = {}
        self.back, self.is_class, self.returns = back, is_class, []
        self.outer: dict[str, str] = {}

    def root(self) -> Frame:
        return self if self.back is None else self.back.root()

    def get(self, name: str, first: bool = True) -> Values | None:
        if name in self.names and (first or not self.is_class):
            return self.names[name]
        return self.back.get(name, False) if self.back else None

    def home(self, name: str) -> Frame:
        how = self.outer.get(name)
        if how == "global":
            return self.root()
        if how == "nonlocal":
            f = self.back
            while f and (f.is_class or name not in f.names):
                f = f.back
            return f or self
        return self

    def set(self, name: str, values: Values) -> None:
        self.home(name).names[name] = values


class Evaluator:
    def __init__(self):
        self.module, self.running, self.missing = Frame(), [], set()

    # --- statements

    def run(self, body: list[ast.stmt], f: Frame) -> None:
        for s in body:
            getattr(self, f"_{type(s).__name__.lower()}", self._other)(s, f)

    def _branches(self, bodies: list[list[ast.stmt]], f: Frame, keep: bool) -> None:
        """All bodies start from the same names; afterwards a name may have what any of them gave it, or what it had if keep."""
        before = dict(f.names)
        ends = [before] if keep else []
        for b in bodies:
            f.names = dict(before)
            self.run(b, f)
            ends.append(f.names)
        names = dict.fromkeys(n for e in ends for n in e)
        f.names = {n: union(*(e[n] for e in ends if n in e)) for n in names}

    def _other(self, s, f):
        for c in ast.iter_child_nodes(s):
            if isinstance(c, ast.expr):
                self.expr(c, f)

    def _assign(self, s, f):
        v = self.expr(s.value, f)
        for t in s.targets:
            self.bind(t, v, f)

    def _annassign(self, s, f):
        if s.value is not None:
            self.bind(s.target, self.expr(s.value, f), f)
        elif isinstance(s.target, ast.Name) and s.target.id not in f.names:
            f.set(s.target.id, [UNKNOWN])

    def _augassign(self, s, f):
        self.bind(s.target, self.expr(ast.BinOp(left=_load(s.target), op=s.op, right=s.value), f), f)

    def bind(self, t: ast.expr, v: Values, f: Frame) -> None:
        if isinstance(t, ast.Name):
            f.set(t.id, v)
        elif isinstance(t, (ast.Tuple, ast.List)):
            star = next((k for k, x in enumerate(t.elts) if isinstance(x, ast.Starred)), None)
            for k, x in enumerate(t.elts):
                if star is None or k < star:
                    self.bind(x, self.item(v, k), f)
                elif k == star:
                    after = len(t.elts) - k - 1
                    parts = [native(list(o.value)[k : len(o.value) - after]) if o.kind == "native" and isinstance(o.value, (list, tuple, str)) else UNKNOWN for o in v]
                    self.bind(x.value, union(parts), f)
                else:
                    self.bind(x, self.item(v, k - len(t.elts)), f)
        elif isinstance(t, ast.Attribute):
            for o in self.expr(t.value, f):
                if o is not UNKNOWN and o is not MORE:
                    o.members[t.attr] = v
        elif isinstance(t, ast.Subscript):
            key, known = self.expr(t.slice, f), len(v) == 1 and v[0].kind == "native"
            for o in self.expr(t.value, f):
                if o.kind == "native" and known and len(key) == 1 and key[0].kind == "native":
                    try:
                        o.value[key[0].value] = v[0].value
                    except Exception:  # noqa: BLE001 - whatever the types do, it is not known
                        pass

    def _if(self, s, f):
        self.expr(s.test, f)
        self._branches([s.body, s.orelse] if s.orelse else [s.body], f, keep=not s.orelse)

    def _for(self, s, f):
        over = self.expr(s.iter, f)
        self.bind(s.target, self.items_of(over), f)
        self._branches([s.body], f, keep=True)
        self.run(s.orelse, f)

    _asyncfor = _for

    def _while(self, s, f):
        self.expr(s.test, f)
        self._branches([s.body], f, keep=True)
        self.run(s.orelse, f)

    def _with(self, s, f):
        for i in s.items:
            v = self.expr(i.context_expr, f)
            if i.optional_vars is not None:
                self.bind(i.optional_vars, [o if o.kind == "instance" else UNKNOWN for o in v], f)
        self.run(s.body, f)

    _asyncwith = _with

    def _try(self, s, f):
        self._branches([[*s.body, *s.orelse], *(h.body for h in s.handlers)], f, keep=False)
        for h in s.handlers:
            if h.name:
                f.names.pop(h.name, None)
        self.run(s.finalbody, f)

    _trystar = _try

    def _match(self, s, f):
        self.expr(s.subject, f)
        for c in s.cases:
            for n in ast.walk(c.pattern):
                if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                    f.set(n.name, [UNKNOWN])
        self._branches([c.body for c in s.cases], f, keep=True)

    def _functiondef(self, s, f):
        fn = Value("function", (s, f), s.name)
        for d in s.decorator_list:
            self.expr(d, f)
        plain = all(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod", "property") for d in s.decorator_list)
        f.set(s.name, [fn] if plain else [UNKNOWN])

    _asyncfunctiondef = _functiondef

    def _classdef(self, s, f):
        inner = Frame(f, is_class=True)
        bases = [v for b in s.bases for v in self.expr(b, f)]
        self.run(s.body, inner)
        members = dict(inner.names)
        for b in bases:
            for n, v in b.members.items():
                members.setdefault(n, v)
        f.set(s.name, [Value("class", bool([b for b in bases if b.kind == "unknown"]), s.name, members)])

    def _return(self, s, f):
        f.returns.append(self.expr(s.value, f) if s.value is not None else [native(None)])

    def _import(self, s, f):
        for a in s.names:
            f.set(a.asname or a.name.split(".")[0], [Value("module", None, a.name if a.asname else a.name.split(".")[0])])

    def _importfrom(self, s, f):
        for a in s.names:
            if a.name != "*":
                f.set(a.asname or a.name, [Value("unknown", None, f"{'.' * s.level}{s.module or ''}.{a.name}")])

    def _delete(self, s, f):
        for t in s.targets:
            if isinstance(t, ast.Name):
                f.home(t.id).names.pop(t.id, None)

    def _global(self, s, f):
        f.outer.update(dict.fromkeys(s.names, "global"))

    def _nonlocal(self, s, f):
        f.outer.update(dict.fromkeys(s.names, "nonlocal"))

    # --- expressions

    def expr(self, e: ast.expr, f: Frame) -> Values:
        return getattr(self, f"_e_{type(e).__name__.lower()}", self._e_other)(e, f)

    def _e_other(self, e, f):
        for c in ast.iter_child_nodes(e):
            if isinstance(c, ast.expr):
                self.expr(c, f)
        return [UNKNOWN]

    def _e_constant(self, e, f):
        return [native(e.value)]

    def _e_name(self, e, f):
        if (v := f.get(e.id)) is not None:
            return v
        if e.id not in scopes.KNOWN:
            self.missing.add(e.id)
        return [UNKNOWN]

    def _e_attribute(self, e, f):
        return union(*(self.member(o, e.attr) for o in self.expr(e.value, f)))

    def member(self, o: Value, name: str) -> Values:
        if name in o.members:
            return o.members[name]
        if o is MORE:
            return [UNKNOWN, MORE]
        if o.kind == "instance" and isinstance(o.value, Value) and name in o.value.members:
            return [Value("function", (*v.value, o), v.name) if v.kind == "function" and len(v.value) == 2 else v for v in o.value.members[name]]
        return [UNKNOWN]

    def _known(self, *parts: Values):
        """All ways to choose one native value of each part; None stands for a part that is not known. The second result is
        whether there are more than MAX_COMBINATIONS ways, of which only so many are given."""
        ways = itertools.product(*parts)
        out = [tuple(v.value for v in w) if all(v.kind == "native" for v in w) else None for w in itertools.islice(ways, MAX_COMBINATIONS)]
        return out, next(ways, None) is not None

    def _compute(self, fn, *parts: Values) -> Values:
        ways, more = self._known(*parts)
        out = []
        for args in ways:
            try:
                x = fn(*args) if args is not None else UNKNOWN
                out.append(x if x is UNKNOWN else native(x) if isinstance(x, _PLAIN) and _small(x) else UNKNOWN)
            except Exception:  # noqa: BLE001 - an operation that fails has no known value
                out.append(UNKNOWN)
        if more or any(v is MORE for p in parts for v in p):
            out += [UNKNOWN, MORE]
        return union(out)

    def _e_binop(self, e, f):
        a, b = self.expr(e.left, f), self.expr(e.right, f)
        op = type(e.op)

        def careful(x, y):
            if op is ast.Pow:
                return x**y if isinstance(y, (int, float)) and abs(y) < 64 and isinstance(x, (int, float)) else UNKNOWN
            if op in (ast.LShift, ast.RShift):
                return (x << y if op is ast.LShift else x >> y) if isinstance(y, int) and 0 <= y < 4096 else UNKNOWN
            if op is ast.Mult and any(isinstance(p, int) and abs(p) > MAX_SIZE and not isinstance(q, (int, float)) for p, q in ((x, y), (y, x))):
                return UNKNOWN
            if op is ast.Mod and isinstance(x, (str, bytes)):
                return UNKNOWN
            return _BINARY[op](x, y) if op in _BINARY else UNKNOWN

        return self._compute(careful, a, b)

    def _e_unaryop(self, e, f):
        v = self.expr(e.operand, f)
        if isinstance(e.op, ast.Not):
            return union(*([native(not t)] if (t := truth(o)) is not None else [UNKNOWN] for o in v))
        return self._compute({ast.USub: lambda x: -x, ast.UAdd: lambda x: +x, ast.Invert: lambda x: ~int(x)}[type(e.op)], v)

    def _e_boolop(self, e, f):
        left, stop = [], isinstance(e.op, ast.Or)
        for part in e.values:
            v = self.expr(part, f)
            left.append([o for o in v if part is e.values[-1] or truth(o) is not (not stop)])
            if all(truth(o) is stop for o in v):
                break
        return union(*left)

    def _e_compare(self, e, f):
        if len(e.ops) > 1:
            parts = [self.expr(x, f) for x in (e.left, *e.comparators)]
            return self._compute(lambda *a: all(_COMPARE[type(o)](x, y) for o, x, y in zip(e.ops, a, a[1:], strict=False)), *parts)
        return self._compute(_COMPARE[type(e.ops[0])], self.expr(e.left, f), self.expr(e.comparators[0], f))

    def _e_ifexp(self, e, f):
        self.expr(e.test, f)
        return union(self.expr(e.body, f), self.expr(e.orelse, f))

    def _e_namedexpr(self, e, f):
        v = self.expr(e.value, f)
        self.bind(e.target, v, f)
        return v

    def _collect(self, elts, f, make):
        parts: list[Any] = []
        for x in elts:
            v = self.expr(x.value if isinstance(x, ast.Starred) else x, f)
            if len(v) != 1 or v[0].kind != "native":
                return [UNKNOWN] if isinstance(x, ast.Starred) else self._mixed(elts, f, make)
            parts += list(v[0].value) if isinstance(x, ast.Starred) and isinstance(v[0].value, (list, tuple, set, str, dict)) else [v[0].value]
        try:
            return [native(make(parts))]
        except TypeError:
            return [UNKNOWN]

    def _mixed(self, elts, f, make):
        """A collection with parts that are not plain: its items are kept as members by position."""
        o = Value("instance", None, make.__name__)
        for k, x in enumerate(elts):
            o.members[f"[{k}]"] = [UNKNOWN] if isinstance(x, ast.Starred) else self.expr(x, f)
        return [o]

    def _e_list(self, e, f):
        return self._collect(e.elts, f, list)

    def _e_tuple(self, e, f):
        return self._collect(e.elts, f, tuple)

    def _e_set(self, e, f):
        return self._collect(e.elts, f, set)

    def _e_dict(self, e, f):
        out: dict = {}
        for k, v in zip(e.keys, e.values, strict=True):
            value = self.expr(v, f)
            key = self.expr(k, f) if k is not None else None
            if len(value) != 1 or value[0].kind != "native" or (key is not None and (len(key) != 1 or key[0].kind != "native")):
                return [Value("instance", None, "dict")]
            try:
                out.update(value[0].value if key is None else {key[0].value: value[0].value})
            except (TypeError, ValueError):
                return [UNKNOWN]
        return [native(out)]

    def item(self, values: Values, k: Any) -> Values:
        out = []
        for o in values:
            if o.kind == "instance" and f"[{k}]" in o.members:
                out.append(o.members[f"[{k}]"])
            elif o.kind == "native":
                try:
                    out.append([native(o.value[k])])
                except Exception:  # noqa: BLE001 - no such item
                    out.append([UNKNOWN])
            else:
                out.append([UNKNOWN, MORE] if o is MORE else [UNKNOWN])
        return union(*out)

    def items_of(self, values: Values) -> Values:
        out = []
        for o in values:
            if o.kind == "native" and isinstance(o.value, (list, tuple, set, dict, str)):
                out.append([native(x) for x in o.value])
            elif o is MORE:
                out.append([UNKNOWN, MORE])
            else:
                out.append([v for k, m in o.members.items() if k.startswith("[") for v in m] if o.kind == "instance" and o.name in ("list", "tuple") else [UNKNOWN])
        return union(*out)

    def _e_subscript(self, e, f):
        base, index = self.expr(e.value, f), self.expr(e.slice, f)
        if len(index) != 1 or index[0].kind != "native":
            return [UNKNOWN]
        return self.item(base, index[0].value)

    def _e_slice(self, e, f):
        parts = [self.expr(x, f) if x is not None else [native(None)] for x in (e.lower, e.upper, e.step)]
        if any(len(p) != 1 or p[0].kind != "native" for p in parts):
            return [UNKNOWN]
        return [native(slice(*(p[0].value for p in parts)))]

    def _comprehension(self, e, f):
        inner = Frame(f)
        for g in e.generators:
            self.bind(g.target, self.items_of(self.expr(g.iter, inner)), inner)
            for c in g.ifs:
                self.expr(c, inner)
        for part in (e.key, e.value) if isinstance(e, ast.DictComp) else (e.elt,):
            self.expr(part, inner)
        g = e.generators[0]
        over = self.expr(g.iter, f)
        if len(e.generators) == 1 and not g.ifs and isinstance(e, ast.ListComp) and len(over) == 1 and over[0].kind == "native" and isinstance(over[0].value, (list, tuple, str)) and len(over[0].value) <= MAX_SIZE:
            out = []
            for x in over[0].value:
                self.bind(g.target, [native(x)], inner)
                v = self.expr(e.elt, inner)
                if len(v) != 1 or v[0].kind != "native":
                    break
                out.append(v[0].value)
            else:
                return [native(out)]
        return [Value("instance", None, {"ListComp": "list", "SetComp": "set", "DictComp": "dict"}.get(type(e).__name__, "generator"))]

    _e_listcomp = _e_setcomp = _e_dictcomp = _e_generatorexp = _comprehension

    def _e_lambda(self, e, f):
        return [Value("function", (e, f), "<lambda>")]

    def _e_starred(self, e, f):
        return self.expr(e.value, f)

    def _e_await(self, e, f):
        self.expr(e.value, f)
        return [UNKNOWN]

    def _e_yield(self, e, f):
        return self.expr(e.value, f) if e.value is not None else [native(None)]

    def _e_joinedstr(self, e, f):
        parts = []
        for x in e.values:
            if isinstance(x, ast.Constant):
                parts.append(str(x.value))
            else:
                v = self.expr(x.value, f)
                if len(v) != 1 or v[0].kind != "native" or x.format_spec or x.conversion != -1:
                    return [Value("instance", None, "str")]
                parts.append(str(v[0].value))
        return [native("".join(parts))]

    def _e_call(self, e, f):
        given, named, rest, more = [], {}, False, False
        for x in e.args:
            v = self.expr(x.value if isinstance(x, ast.Starred) else x, f)
            if not isinstance(x, ast.Starred):
                given += [] if rest else [v]
            elif (items := self._spread(v)) is None:  # from here on positions are not known
                rest = True
            else:
                given += [] if rest else items
        for k in e.keywords:
            v = self.expr(k.value, f)
            if k.arg:
                named[k.arg] = v
            elif len(v) == 1 and v[0].kind == "native" and isinstance(v[0].value, dict):
                named.update({n: [native(x)] for n, x in v[0].value.items()})
            else:
                more = True
        return union(*(self.call(o, given, named, rest, more) for o in self.expr(e.func, f)))

    @staticmethod
    def _spread(v: Values) -> list[Values] | None:
        """The arguments a starred value stands for, if they are known."""
        if len(v) != 1:
            return None
        o = v[0]
        if o.kind == "native":
            return [[native(x)] for x in o.value] if isinstance(o.value, (list, tuple, str, dict, set)) else None
        items = [m for k, m in o.members.items() if k.startswith("[")] if o.kind == "instance" and o.name in ("list", "tuple") else []
        return items if items and [UNKNOWN] not in items else None

    def call(self, o: Value, args: list[Values], named: dict[str, Values], rest: bool = False, more: bool = False) -> Values:
        """rest and more: there are further arguments of which neither number nor values are known, by position and by name."""
        if o.kind == "class":
            made = Value("instance", o, o.name)
            for init in self.member(made, "__init__"):
                if init.kind == "function":
                    self.call(init, args, named, rest, more)
            return [made]
        if o.kind != "function":
            return [UNKNOWN, MORE] if o is MORE else [UNKNOWN]
        node, home, *bound = o.value
        if node in self.running:  # recursion is not followed
            return [UNKNOWN]
        if len(self.running) >= MAX_DEPTH:
            return [UNKNOWN, MORE]
        f, a = Frame(home), node.args
        plain = [p.arg for p in (*a.posonlyargs, *a.args)]
        is_static = isinstance(node, ast.FunctionDef) and any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
        given = ([[b] for b in bound] if not is_static else []) + args
        defaults = dict(zip(plain[len(plain) - len(a.defaults) :], a.defaults, strict=True)) | {p.arg: d for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d}
        for p in scopes.parameters(a):
            f.names[p.arg] = self.expr(defaults[p.arg], home) if p.arg in defaults else [UNKNOWN]
            if (rest and p.arg in plain[len(given) :]) or (more and p.arg not in plain[: len(given)] and p not in a.posonlyargs):
                f.names[p.arg] = union(f.names[p.arg], [UNKNOWN])
        for p, v in zip(plain, given, strict=False):
            f.names[p] = v
        by_name = {p.arg for p in (*a.args, *a.kwonlyargs)}
        f.names.update({k: v for k, v in named.items() if k in by_name})
        if a.vararg:
            extra = given[len(plain) :]
            known = not rest and all(len(v) == 1 and v[0].kind == "native" for v in extra)
            f.names[a.vararg.arg] = [native(tuple(v[0].value for v in extra))] if known else [Value("instance", None, "tuple", {} if rest else {f"[{k}]": v for k, v in enumerate(extra)})]
        if a.kwarg:
            extra = {k: v for k, v in named.items() if k not in by_name}
            known = not more and all(len(v) == 1 and v[0].kind == "native" for v in extra.values())
            f.names[a.kwarg.arg] = [native({k: v[0].value for k, v in extra.items()})] if known else [Value("instance", None, "dict")]
        self.running.append(node)
        try:
            if isinstance(node, ast.Lambda):
                return self.expr(node.body, f)
            self.run(node.body, f)
        finally:
            self.running.pop()
        if any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in ast.walk(node)):
            return [Value("instance", None, "generator")]
        return union(*f.returns) if f.returns else [native(None)]


def _load(t: ast.expr) -> ast.expr:
    return ast.Name(t.id, ast.Load()) if isinstance(t, ast.Name) else t


def evaluate(tree: ast.Module) -> dict[str, Values]:
    """The possible values of every name of the module."""
    e = Evaluator()
    e.run(tree.body, e.module)
    return e.module.names
