"""A compiler for a small sandboxed template language.

``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in xs %}``,
``{% set x = e %}``, ``{% generation %} ... {% endgeneration %}`` and ``{# comment #}``; a dash inside
a tag trims the white space beside it. Expressions have literals, names, keys (``a.b``, ``a['b']``),
comparisons, ``in``, ``and or not``, ``+ - * ~``, ``x if c else y`` and filters. There are no calls and
no attributes of Python objects: keys are looked up in mappings only.

Source text becomes a syntax tree, constants are folded, and the tree becomes Python closures.
Statements are generators, and a loop takes any iterator, so a conversation is rendered as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

TAG = re.compile(r"\{\{-?|\{%-?|\{#")
TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\].,|~+*-]|=))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template doesn't follow the language, or uses a name or key that isn't there."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    """An operation on expressions: kind is an operator, ``key``, ``pick`` or ``filter:<name>``."""

    kind: str
    args: tuple


@dataclass
class Text:
    value: str


@dataclass
class Emit:
    expr: object


@dataclass
class Set:
    name: str
    expr: object


@dataclass
class If:
    arms: list = field(default_factory=list)  # (condition, body)


@dataclass
class For:
    name: str
    expr: object
    body: list


@dataclass
class Generation:
    body: list


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Expressions:
    """Precedence climbing over one tag's tokens."""

    LEVELS = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*",)]

    def __init__(self, source: str):
        self.toks, self.at = tokens(source), 0

    def peek(self) -> str:
        return self.toks[self.at][1] if self.toks[self.at][0] in ("op", "name") else ""

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.toks[self.at - 1]

    def take(self, what: str) -> None:
        if self.next()[1] != what:
            raise TemplateError(f"expected {what!r}")

    def end(self) -> None:
        if self.toks[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")

    def full(self):
        out = self.ternary()
        self.end()
        return out

    def ternary(self):
        value = self.level(0)
        if self.peek() == "if":
            self.next()
            test = self.level(0)
            self.take("else")
            return Op("pick", (test, value, self.ternary()))
        return value

    def level(self, n: int):
        if n == len(self.LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek() in self.LEVELS[n] or n == 2 and self.peek() == "not":
            op = self.next()[1]
            if op == "not":
                self.take("in")
                left = Op("not", (Op("in", (left, self.level(n + 1))),))
            else:
                left = Op(op, (left, self.level(n + 1)))
        return left

    def unary(self):
        if self.peek() == "not":
            self.next()
            return Op("not", (self.level(2),))
        if self.peek() == "-":
            self.next()
            return Op("-", (Const(0), self.unary()))
        return self.postfix()

    def postfix(self):
        out = self.atom()
        while (op := self.peek()) in (".", "[", "|") and op:
            self.next()
            if op == ".":
                out = Op("key", (out, Const(self.ident())))
            elif op == "[":
                out = Op("key", (out, self.ternary()))
                self.take("]")
            else:
                name, args = self.ident(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.peek() == "(":
                    self.next()
                    while self.peek() != ")":
                        args.append(self.ternary())
                        if self.peek() == ",":
                            self.next()
                    self.take(")")
                out = Op(f"filter:{name}", (out, *args))
        return out

    def ident(self) -> str:
        kind, value = self.next()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"bad name {value!r}")
        return value

    def atom(self):
        kind, value = self.next()
        if kind == "num":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            if value in CONSTANTS:
                return Const(CONSTANTS[value])
            if value.startswith("_"):
                raise TemplateError(f"bad name {value!r}")
            return Name(value)
        if value == "(":
            out = self.ternary()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The syntax tree: a list of statements."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    at, trim = 0, False
    while True:
        m = TAG.search(source, at)
        text = source[at:m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            stack[-1][2].append(Text(text))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        stop = _tag_end(source, m.end(), close)
        inner = source[m.end():stop]
        trim = inner.endswith("-")
        inner = inner[:-1] if trim else inner
        at = stop + 2
        if close == "}}":
            stack[-1][2].append(Emit(Expressions(inner).full()))
        elif close == "%}":
            _statement(inner, stack)
    if len(stack) > 1:
        raise TemplateError(f"{{% {stack[-1][0]} %}} isn't closed")
    return root


def _tag_end(source: str, at: int, close: str) -> int:
    """Where the tag ends, not counting what stands in quotes."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif close != "#}" and c in "'\"":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    raise TemplateError(f"no {close}")


def _statement(inner: str, stack: list) -> None:
    word, _, rest = inner.strip().partition(" ")
    kind, node, body = stack[-1]
    if word == "if":
        new = If([(Expressions(rest).full(), [])])
        body.append(new)
        stack.append(("if", new, new.arms[0][1]))
    elif word in ("elif", "else") and kind == "if":
        node.arms.append((Expressions(rest).full() if word == "elif" else Const(True), []))
        stack[-1] = ("if", node, node.arms[-1][1])
    elif word == "for":
        e = Expressions(rest)
        name = e.ident()
        e.take("in")
        new = For(name, e.full(), [])
        body.append(new)
        stack.append(("for", new, new.body))
    elif word == "set":
        e = Expressions(rest)
        name = e.ident()
        e.take("=")
        body.append(Set(name, e.full()))
    elif word == "generation":
        new = Generation([])
        body.append(new)
        stack.append(("generation", new, new.body))
    elif word == f"end{kind}" and kind:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {{% {inner.strip()} %}}")


def _show(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _key(value: object, key: object) -> object:
    if not isinstance(value, Mapping):
        raise TemplateError(f"{key!r} of something that isn't a mapping")
    if key not in value:
        raise TemplateError(f"no key {key!r}")
    return value[key]


#: Filters by name; a caller may add its own to a template.
FILTERS: dict[str, Callable] = {
    "upper": lambda x: _show(x).upper(),
    "lower": lambda x: _show(x).lower(),
    "trim": lambda x: _show(x).strip(),
    "length": lambda x: len(x) if x is not None else 0,
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, a, b: _show(x).replace(a, b),
    "guard": None,  # bound by the caller: makes control strings harmless
}
OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "~": lambda a, b: _show(a) + _show(b), "key": _key,
}


def _function(kind: str, filters: dict) -> Callable:
    return filters[kind[7:]] if kind.startswith("filter:") else OPS[kind]


def fold(node, filters: dict):
    """The expression with all that doesn't depend on names evaluated."""
    if not isinstance(node, Op):
        return node
    args = tuple(fold(x, filters) for x in node.args)
    if node.kind in ("pick", "and", "or") and isinstance(args[0], Const):
        if node.kind == "pick":
            return args[1] if args[0].value else args[2]
        return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
    if node.kind not in ("pick", "and", "or") and all(isinstance(x, Const) for x in args):
        return Const(_function(node.kind, filters)(*(x.value for x in args)))
    return Op(node.kind, args)


def fold_body(body: list, filters: dict) -> list:
    """Statements with folded expressions, dead branches removed and neighbouring text joined."""
    out: list = []
    for node in body:
        if isinstance(node, Emit):
            e = fold(node.expr, filters)
            node = Text(_show(e.value)) if isinstance(e, Const) else Emit(e)
        elif isinstance(node, Set):
            node = Set(node.name, fold(node.expr, filters))
        elif isinstance(node, For):
            node = For(node.name, fold(node.expr, filters), fold_body(node.body, filters))
        elif isinstance(node, Generation):
            node = Generation(fold_body(node.body, filters))
        elif isinstance(node, If):
            arms = []
            for test, inner in node.arms:
                test = fold(test, filters)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, fold_body(inner, filters)))
                if isinstance(test, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for x in arms[0][1]:
                    _append(out, x)
                continue
            if not arms:
                continue
            node = If(arms)
        _append(out, node)
    return out


def _append(out: list, node) -> None:
    if isinstance(node, Text) and out and isinstance(out[-1], Text):
        out[-1] = Text(out[-1].value + node.value)
    elif not (isinstance(node, Text) and not node.value):
        out.append(node)


def _expr(node, filters: dict) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda ctx: value
    if isinstance(node, Name):
        name = node.name

        def look(ctx):
            if name not in ctx:
                raise TemplateError(f"no name {name!r}")
            return ctx[name]

        return look
    args = [_expr(x, filters) for x in node.args]
    if node.kind == "pick":
        return lambda ctx: args[1](ctx) if args[0](ctx) else args[2](ctx)
    if node.kind == "and":
        return lambda ctx: args[0](ctx) and args[1](ctx)
    if node.kind == "or":
        return lambda ctx: args[0](ctx) or args[1](ctx)
    f = _function(node.kind, filters)
    if len(args) == 1:
        return lambda ctx, a=args[0]: f(a(ctx))
    return lambda ctx: f(*(a(ctx) for a in args))


def _body(body: list, filters: dict, marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps = [_step(x, filters, marked) for x in body]

    def run(ctx):
        for step in steps:
            yield from step(ctx)

    return run


def _step(node, filters: dict, marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    if isinstance(node, Text):
        piece = (node.value, marked)
        return lambda ctx: (piece,)
    if isinstance(node, Emit):
        e = _expr(node.expr, filters)
        return lambda ctx: ((_show(e(ctx)), marked),)
    if isinstance(node, Set):
        e, name = _expr(node.expr, filters), node.name

        def assign(ctx):
            ctx[name] = e(ctx)
            return ()

        return assign
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        arms = [(_expr(t, filters), _body(b, filters, marked)) for t, b in node.arms]

        def choose(ctx):
            for test, inner in arms:
                if test(ctx):
                    return inner(ctx)
            return ()

        return choose
    items, inner, name = _expr(node.expr, filters), _body(node.body, filters, marked), node.name

    def loop(ctx):
        it, n = iter(items(ctx)), 0
        end = object()
        now = next(it, end)
        while now is not end:
            following = next(it, end)
            own = ctx | {name: now, "loop": {"index": n + 1, "index0": n, "first": n == 0, "last": following is end}}
            yield from inner(own)
            now, n = following, n + 1

    return loop


def compile_template(source: str, **filters: Callable) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of named values that yields (text, under a generation marker) in order."""
    known = FILTERS | filters
    run = _body(fold_body(parse(source), known), known, False)
    return lambda **values: run(dict(values))
