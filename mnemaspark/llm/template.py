"""A compiler for chat templates: source -> syntax tree -> folded tree -> Python closures.

The language: ``{{ expr }}``, ``{% for x in expr %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = expr %}``, ``{% generation %}`` (text that the model is to learn), comments
``{# #}`` and ``-`` at a tag's edge to trim white space. Expressions: literals, names, ``a.b``
and ``a['b']``, ``+ ~ == != < <= > >= in not and or``, ``x if c else y``, ``x | filter``.

It is a sandbox: names come from the context alone, ``.`` and ``[]`` read keys of mappings
and items of lists, never attributes of Python objects, nothing can be called but the
filters listed here, and a render stops after ``MAX_STEPS`` loop turns.

A compiled template yields its output piece by piece, so a conversation of any length
is rendered in the memory of a few turns. Loops look one item ahead for ``loop.last``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

MAX_STEPS = 100_000_000


_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<op>==|!=|<=|>=|[-+~<>|().,\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class Mark(Enum):
    """Around text under the loss mask."""

    BEGIN = 1
    END = 2


BEGIN, END = Mark.BEGIN, Mark.END


# ---- tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    id: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Call:
    """An operator or filter on its operands; pure, so constant operands fold."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass
class Output:
    expr: Any


@dataclass
class For:
    var: str
    over: Any
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list  # of (test, body); an else arm's test is Const(True)


@dataclass
class Set:
    var: str
    expr: Any


@dataclass
class Generation:
    body: list


# ---- control strings ----------------------------------------------------------------------


def escape_control(text: str) -> str:
    """Text without ``<|``; ``unescape_control`` gives the original back, whatever it held."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape_control(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_PURE: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
    "-": lambda a: -a,
    "|trim": lambda a: _text(a).strip(),
    "|lower": lambda a: _text(a).lower(),
    "|upper": lambda a: _text(a).upper(),
    "|length": lambda a: len(a),
    "|default": lambda a, b="": b if a is None else a,
    "|string": _text,
    "|tojson": lambda a: json.dumps(a, ensure_ascii=False, sort_keys=True),
    "|escape_control": lambda a: escape_control(_text(a)),
}

# ---- parser -------------------------------------------------------------------------------


class _Expr:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else value

    def take(self, *values: str) -> bool:
        if self.peek() in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        yes = self.either()
        if self.take("if"):
            test = self.either()
            no = self.choice() if self.take("else") else Const(None)
            return Choice(test, yes, no)
        return yes

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Choice(left, left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Choice(left, self.negated(), left)
        return left

    def negated(self):
        return Call("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while True:
            op = self.peek()
            if op in ("==", "!=", "<", "<=", ">", ">=", "in"):
                self.at += 1
                left = Call(op, (left, self.joined()))
            elif op == "not" and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = Call("not", (Call("in", (left, self.joined())),))
            else:
                return left

    def joined(self):
        left = self.filtered()
        while (op := self.peek()) in ("+", "~"):
            self.at += 1
            left = Call(op, (left, self.filtered()))
        return left

    def filtered(self):
        left = self.primary()
        while self.take("|"):
            args, name = [left], "|" + self.name()
            if name not in _PURE:
                raise TemplateError(f"no filter {name[1:]!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    self.take(",")
            left = Call(name, tuple(args))
        return left

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            tree = Const(int(value))
        elif kind == "str":
            tree = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "name":
            tree = {"true": Const(True), "false": Const(False), "none": Const(None)}.get(value.lower(), Name(value))
        elif value == "(":
            tree = self.choice()
            self.need(")")
        elif value == "-":
            tree = Call("-", (self.primary(),))
        else:
            raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take("."):
                tree = Item(tree, Const(self.name()))
            elif self.take("["):
                tree = Item(tree, self.choice())
                self.need("]")
            else:
                return tree


def parse(source: str) -> list:
    """The syntax tree of a template: a list of statements."""
    pieces = _TAG.split(source)
    for i in range(1, len(pieces), 2):
        if pieces[i][2:3] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3:-2] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    root: list = []
    open_: list[tuple[str, Any, list]] = [("", None, root)]
    for i, piece in enumerate(pieces):
        body = open_[-1][2]
        if i % 2 == 0:
            if piece:
                body.append(Output(Const(piece)))
            continue
        if piece.startswith("{#"):
            continue
        inner = piece[2:-2].strip("-").strip()
        if piece.startswith("{{"):
            body.append(Output(_Expr(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            var, _, over = rest.partition(" in ")
            node: Any = For(var.strip(), _Expr(over).whole())
            if not node.var.isidentifier():
                raise TemplateError(f"can't loop with {node.var!r}")
            body.append(node)
            open_.append(("for", node, node.body))
        elif word == "if":
            node = If([(_Expr(rest).whole(), [])])
            body.append(node)
            open_.append(("if", node, node.arms[0][1]))
        elif word in ("elif", "else") and open_[-1][0] == "if":
            _, node, _ = open_.pop()
            node.arms.append((_Expr(rest).whole() if word == "elif" else Const(True), []))
            open_.append(("if", node, node.arms[-1][1]))
        elif word == "set":
            var, _, value = rest.partition("=")
            body.append(Set(var.strip(), _Expr(value).whole()))
        elif word == "generation":
            node = Generation([])
            body.append(node)
            open_.append(("generation", node, node.body))
        elif word.startswith("end") and word[3:] == open_[-1][0] and word != "end":
            open_.pop()
        else:
            raise TemplateError(f"unexpected tag {piece!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} isn't closed")
    return root


# ---- folding ------------------------------------------------------------------------------


def fold_expr(e):
    if isinstance(e, Item):
        return Item(fold_expr(e.of), fold_expr(e.key))
    if isinstance(e, Choice):
        test = fold_expr(e.test)
        if isinstance(test, Const):
            return fold_expr(e.yes if test.value else e.no)
        return Choice(test, fold_expr(e.yes), fold_expr(e.no))
    if isinstance(e, Call):
        args = tuple(map(fold_expr, e.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_PURE[e.op](*(a.value for a in args)))
        return Call(e.op, args)
    return e


def fold(body: list) -> list:
    """The same template with constant expressions computed, constant tests decided, texts joined."""
    out: list = []
    for node in body:
        if isinstance(node, Output):
            expr = fold_expr(node.expr)
            pieces = list(expr.args) if isinstance(expr, Call) and expr.op == "~" else [expr]
            for e in pieces:
                if isinstance(e, Const):
                    e = Const(_text(e.value))
                    if not e.value:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                        out[-1] = Output(Const(out[-1].expr.value + e.value))
                        continue
                out.append(Output(e))
        elif isinstance(node, For):
            out.append(For(node.var, fold_expr(node.over), fold(node.body)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body)))
        elif isinstance(node, Set):
            out.append(Set(node.var, fold_expr(node.expr)))
        else:
            arms = []
            for test, arm in node.arms:
                test = fold_expr(test)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, fold(arm)))
                if isinstance(test, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                out += arms[0][1]
            elif arms:
                out.append(If(arms))
    return out


# ---- closures -----------------------------------------------------------------------------

Env = dict[str, Any]


def _item(of, key):
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _expr(e) -> Callable[[Env], Any]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.id
        return lambda env: env.get(name)
    if isinstance(e, Item):
        of, key = _expr(e.of), _expr(e.key)
        return lambda env: _item(of(env), key(env))
    if isinstance(e, Choice):
        test, yes, no = _expr(e.test), _expr(e.yes), _expr(e.no)
        return lambda env: yes(env) if test(env) else no(env)
    fn, args = _PURE[e.op], [_expr(a) for a in e.args]
    if len(args) == 1:
        one = args[0]
        return lambda env: fn(one(env))
    return lambda env: fn(*(a(env) for a in args))


def _node(node) -> Callable[[Env], Iterator]:
    if isinstance(node, Output):
        if isinstance(node.expr, Const):
            pieces = (node.expr.value,)
            return lambda env: pieces
        expr = _expr(node.expr)
        return lambda env: (_text(expr(env)),)
    if isinstance(node, Set):
        var, value = node.var, _expr(node.expr)

        def assign(env):
            env[var] = value(env)
            return ()

        return assign
    if isinstance(node, Generation):
        inner = _body(node.body)

        def generation(env):
            yield BEGIN
            yield from inner(env)
            yield END

        return generation
    if isinstance(node, If):
        arms = [(_expr(test), _body(body)) for test, body in node.arms]

        def choose(env):
            for test, body in arms:
                if test(env):
                    return body(env)
            return ()

        return choose
    var, over, body = node.var, _expr(node.over), _body(node.body)

    def loop(env):
        items, index = iter(over(env) or ()), 0
        item = next(items, END)
        while item is not END:
            following = next(items, END)
            index += 1
            env["op1 steps"] = env.get("op1 steps", 0) + 1
            if env["op1 steps"] > MAX_STEPS:
                raise TemplateError(f"over {MAX_STEPS} steps")
            env[var], env["loop"] = item, {"index": index, "index0": index - 1, "first": index == 1, "last": following is END}
            yield from body(env)
            item = following

    return loop


def _body(body: list) -> Callable[[Env], Iterator]:
    nodes = [_node(n) for n in body]
    if len(nodes) == 1:
        return nodes[0]

    def run(env):
        for n in nodes:
            yield from n(env)

    return run


def _uses(tree, name: str) -> int:
    if isinstance(tree, Name):
        return int(tree.id == name)
    if isinstance(tree, (list, tuple)):
        return sum(_uses(x, name) for x in tree)
    return sum(_uses(v, name) for v in vars(tree).values()) if hasattr(tree, "__dataclass_fields__") else 0


def _streams(body: list) -> bool:
    """Whether ``messages`` is read once, by a loop that no other loop holds."""
    return _uses(body, "messages") == 1 and any(isinstance(n, For) and n.over == Name("messages") for n in body)


def compile_template(source: str) -> Callable[[Iterable[Mapping[str, Any]], Mapping[str, Any]], Iterator]:
    """A function of (messages, context) that yields strings, BEGIN and END."""
    tree = fold(parse(source))
    run, lazy = _body(tree), _streams(tree)

    def render(messages, context=()):
        return run({**dict(context), "messages": messages if lazy else list(messages)})

    return render
