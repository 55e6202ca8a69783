"""A small sandboxed template language, compiled to Python closures.

``{{ e }}`` prints; ``{% if e %} {% elif e %} {% else %} {% endif %}``, ``{% for x in e %} {% endfor %}`` (with
loop.index, loop.index0, loop.first, loop.last), ``{% set x = e %}`` and ``{% generation %} {% endgeneration %}``
control. Expressions have strings, whole numbers, true, false, none, names, ``a.b`` and ``a[b]`` on maps
and lists, ``| filter``, ``not and or``, ``== != < <= > >= in``, ``+ - * % ~`` and ``a if c else b``.

Nothing else can be reached: there are no calls, a name or member that is missing is none, members
are looked up in maps and lists only, and filters come from a fixed table. Constant parts are computed while
compiling, branches with constant conditions are chosen then, and neighbouring texts are joined.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>|.()\[\]=]))"""
)
PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """A template that is not of the language, or that fails on its data."""


def show(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _less(test: Callable) -> Callable:
    def compare(a: object, b: object) -> bool:
        if type(a) is not type(b) or not isinstance(a, (int, str)):
            raise TemplateError("values that have no order")
        return test(a, b)

    return compare


def _number(work: Callable) -> Callable:
    def compute(a: object, b: object) -> object:
        strings = work is operator.add and isinstance(a, str) and isinstance(b, str)
        if not strings and not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("arithmetic with what is no number")
        if work is operator.mod and b == 0:
            raise TemplateError("division by zero")
        return work(a, b)

    return compute


BINARY: dict[str, Callable] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": _less(operator.lt),
    "<=": _less(operator.le),
    ">": _less(operator.gt),
    ">=": _less(operator.ge),
    "in": lambda a, b: isinstance(b, (str, list, dict)) and (not isinstance(b, str) or isinstance(a, str)) and a in b,
    "+": _number(operator.add),
    "-": _number(operator.sub),
    "*": _number(operator.mul),
    "%": _number(operator.mod),
    "~": lambda a, b: show(a) + show(b),
}
LEVELS = [["==", "!=", "<", "<=", ">", ">=", "in"], ["+", "-", "~"], ["*", "%"]]
FILTERS: dict[str, Callable] = {
    "trim": lambda v: show(v).strip(),
    "upper": lambda v: show(v).upper(),
    "lower": lambda v: show(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "first": lambda v: v[0] if isinstance(v, (str, list)) and v else None,
    "last": lambda v: v[-1] if isinstance(v, (str, list)) and v else None,
    "string": show,
}


def member(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key) if isinstance(key, (str, int)) else None
    if isinstance(value, (list, str)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


# --- syntax tree: tuples whose first entry names the node ----------------------------------------


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.tokens, self.at, self.filters = [], 0, filters
        place, source = 0, source.rstrip()
        while place < len(source):
            m = TOKEN.match(source, place)
            if not m:
                raise TemplateError(f"cannot read {source[place:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return ("choice", condition, value, self.choice())
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        if self.take("not"):
            return ("not", self.negation())
        return self.binary(0)

    def binary(self, level: int) -> tuple:
        if level == len(LEVELS):
            return self.postfix()
        left = self.binary(level + 1)
        while op := self.take(*LEVELS[level]):
            left = ("binary", op, left, self.binary(level + 1))
        return left

    def postfix(self) -> tuple:
        value = self.atom()
        while True:
            if self.take("."):
                value = ("member", value, ("constant", self.name()))
            elif self.take("["):
                value = ("member", value, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                value = ("filter", name, value)
            else:
                return value

    def atom(self) -> tuple:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("-"):
            return ("binary", "-", ("constant", 0), self.postfix())
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "number":
            return ("constant", int(text))
        if kind == "name":
            return ("constant", WORDS[text]) if text in WORDS else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


class Parser:
    """Splits a template into parts and nests its blocks."""

    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.filters, self.parts, end = filters, [], 0
        for m in PARTS.finditer(source):
            if m.start() > end:
                self.parts.append(("text", source[end : m.start()]))
            self.parts.append(("print", m[1]) if m[1] is not None else ("block", m[2].strip()))
            end = m.end()
        if end < len(source):
            self.parts.append(("text", source[end:]))
        self.at = 0

    def expression(self, source: str) -> tuple:
        return Expression(source, self.filters).whole()

    def body(self, *ends: str) -> tuple[list, str]:
        """Nodes up to one of the closing words, and the block that closes them."""
        nodes = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(("constant", text))
                continue
            if kind == "print":
                nodes.append(("print", self.expression(text)))
                continue
            word = text.split(None, 1)[0] if text else ""
            rest = text[len(word) :].strip()
            if word in ends:
                return nodes, text
            if word == "if":
                nodes.append(self.condition(rest))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                if not m:
                    raise TemplateError("for needs a name and a list")
                inside, _ = self.body("endfor")
                nodes.append(("for", m[1], self.expression(m[2]), inside))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.DOTALL)
                if not m:
                    raise TemplateError("set needs a name and a value")
                nodes.append(("set", m[1], self.expression(m[2])))
            elif word == "generation" and not rest:
                inside, _ = self.body("endgeneration")
                nodes.append(("generation", inside))
            else:
                raise TemplateError(f"unexpected block {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def condition(self, test: str) -> tuple:
        tree = self.expression(test)
        inside, closing = self.body("elif", "else", "endif")
        if closing.startswith("elif"):
            return ("if", tree, inside, [self.condition(closing[4:].strip())])
        other = self.body("endif")[0] if closing == "else" else []
        return ("if", tree, inside, other)


# --- constants ----------------------------------------------------------------------------------


def fold(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """An expression with its constant parts computed."""
    kind = tree[0]
    again = lambda t: fold(t, filters)
    still = lambda *ts: all(t[0] == "constant" for t in ts)
    if kind == "not":
        value = again(tree[1])
        return ("constant", not value[1]) if still(value) else (kind, value)
    if kind in ("and", "or"):
        left, right = again(tree[1]), again(tree[2])
        if still(left):
            return (right if left[1] else left) if kind == "and" else (left if left[1] else right)
        return (kind, left, right)
    if kind == "choice":
        test, yes, no = map(again, tree[1:])
        return (yes if test[1] else no) if still(test) else (kind, test, yes, no)
    if kind == "binary":
        left, right = again(tree[2]), again(tree[3])
        return ("constant", BINARY[tree[1]](left[1], right[1])) if still(left, right) else (kind, tree[1], left, right)
    if kind == "filter":
        value = again(tree[2])
        return ("constant", filters[tree[1]](value[1])) if still(value) else (kind, tree[1], value)
    if kind == "member":
        value, key = again(tree[1]), again(tree[2])
        return ("constant", member(value[1], key[1])) if still(value, key) else (kind, value, key)
    return tree


def fold_body(nodes: list, filters: dict[str, Callable]) -> list:
    """Nodes with constant prints turned into text, constant conditions decided and texts joined."""
    out: list = []

    def add(node: tuple) -> None:
        if node[0] == "constant":
            if out and out[-1][0] == "constant":
                node = ("constant", out.pop()[1] + node[1])
            if not node[1]:
                return
        out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "print":
            value = fold(node[1], filters)
            add(("constant", show(value[1])) if value[0] == "constant" else ("print", value))
        elif kind == "if":
            test, yes, no = fold(node[1], filters), fold_body(node[2], filters), fold_body(node[3], filters)
            if test[0] == "constant":
                for inner in yes if test[1] else no:
                    add(inner)
            else:
                add(("if", test, yes, no))
        elif kind == "for":
            add(("for", node[1], fold(node[2], filters), fold_body(node[3], filters)))
        elif kind == "set":
            add(("set", node[1], fold(node[2], filters)))
        elif kind == "generation":
            add(("generation", fold_body(node[1], filters)))
        else:
            add(node)
    return out


# --- closures -----------------------------------------------------------------------------------

Scope = dict[str, object]


class Output:
    """Text so far, its length, and the spans that were generated."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.size += len(text)


def evaluator(tree: tuple, filters: dict[str, Callable]) -> Callable[[Scope], object]:
    kind = tree[0]
    sub = [evaluator(t, filters) if isinstance(t, tuple) else t for t in tree[1:]] if kind != "constant" else []
    if kind == "constant":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "not":
        return lambda scope, f=sub[0]: not f(scope)
    if kind == "and":
        return lambda scope, f=sub[0], g=sub[1]: f(scope) and g(scope)
    if kind == "or":
        return lambda scope, f=sub[0], g=sub[1]: f(scope) or g(scope)
    if kind == "choice":
        return lambda scope, c=sub[0], f=sub[1], g=sub[2]: f(scope) if c(scope) else g(scope)
    if kind == "binary":
        return lambda scope, op=BINARY[tree[1]], f=sub[1], g=sub[2]: op(f(scope), g(scope))
    if kind == "filter":
        return lambda scope, op=filters[tree[1]], f=sub[1]: op(f(scope))
    return lambda scope, f=sub[0], g=sub[1]: member(f(scope), g(scope))


def writer(nodes: list, filters: dict[str, Callable]) -> Callable[[Scope, Output], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(scope: Scope, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple, filters: dict[str, Callable]) -> Callable[[Scope, Output], None]:
    kind = node[0]
    if kind == "constant":
        return lambda scope, out, text=node[1]: out.put(text)
    if kind == "print":
        return lambda scope, out, f=evaluator(node[1], filters): out.put(show(f(scope)))
    if kind == "set":

        def assign(scope: Scope, out: Output, name=node[1], f=evaluator(node[2], filters)) -> None:
            scope[name] = f(scope)

        return assign
    if kind == "if":
        test, yes, no = evaluator(node[1], filters), writer(node[2], filters), writer(node[3], filters)
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    if kind == "generation":
        inside = writer(node[1], filters)

        def generate(scope: Scope, out: Output) -> None:
            start = out.size
            inside(scope, out)
            out.spans.append((start, out.size))

        return generate
    name, items, inside = node[1], evaluator(node[2], filters), writer(node[3], filters)

    def loop(scope: Scope, out: Output) -> None:
        values = items(scope)
        if not isinstance(values, list):
            raise TemplateError("for needs a list")
        inner, n = dict(scope), len(values)  # names set in a loop end with it
        for k, value in enumerate(values):
            inner[name] = value
            inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == n - 1, "length": n}
            inside(inner, out)

    return loop


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[[Scope], tuple[str, list[tuple[int, int]]]]:
    """A function from data to the rendered text and the spans inside ``generation`` blocks."""
    known = FILTERS | (filters or {})
    nodes, _ = Parser(source, known).body()
    run = writer(fold_body(nodes, known), known)

    def render(data: Scope) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(data), out)
        return "".join(out.parts), out.spans

    return render
