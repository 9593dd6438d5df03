"""XPath 1.0 with extensions: text to syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

AXES = frozenset("child descendant descendant-or-self parent ancestor ancestor-or-self following-sibling preceding-sibling following preceding attribute namespace self".split())
REVERSE = frozenset(["ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent"])
KINDS = frozenset("node text comment processing-instruction element".split())


class XPathError(ValueError):
    """The text is not an expression, or uses what is not there."""


@dataclass(frozen=True)
class Test:
    """kind: one of KINDS, or "name"; local "*" and prefix None are wild."""

    kind: str
    local: str | None = None
    prefix: str | None = ""


@dataclass(frozen=True)
class Step:
    axis: str
    test: Test
    predicates: tuple = ()


@dataclass(frozen=True)
class Path:
    """start: None (the context), "root", or an expression."""

    start: object
    steps: tuple = ()


@dataclass(frozen=True)
class Filter:
    """(expression)[predicates]"""

    base: object
    predicates: tuple


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Literal:
    value: object = field(default=None)


@dataclass(frozen=True)
class Variable:
    name: str


NAME = r"[^\W\d][\w.\-]*"
TOKEN = re.compile(rf"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>::|//|->|\.\.|!=|<=|>=|[()\[\]@,/|+\-=<>*.${{}}:])|(?P<name>{NAME}))")
LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise XPathError(f"unexpected character at {at} in {text!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m.group(kind)))
            at = m.end()
        self.at = 0
        self.text = text

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, found = self.peek()
        if kind == "end" or (value is not None and (found != value or kind == "str")):
            raise XPathError(f"expected {value or 'more'} but found {found or 'the end'} in {self.text!r}")
        self.at += 1
        return found

    def accept(self, value: str) -> bool:
        if self.peek() in (("op", value), ("name", value)):
            self.at += 1
            return True
        return False

    def parse(self):
        out = self.binary(0)
        if self.peek()[0] != "end":
            raise XPathError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return out

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in LEVELS[level]:
            op = self.take()
            left = Op(op, (left, self.binary(level + 1)))
        return left

    def unary(self):
        if self.accept("-"):
            return Op("neg", (self.unary(),))
        left = self.path()
        while self.accept("|"):
            left = Op("|", (left, self.path()))
        return left

    def path(self):
        kind, value = self.peek()
        if (kind, value) in (("op", "/"), ("op", "//")):
            self.take()
            steps = [Step("descendant-or-self", Test("node"))] if value == "//" else []
            if value == "//" or self.starts_step():
                steps += self.steps()
            return Path("root", collapsed(steps))
        if self.starts_primary():
            base = self.primary()
            predicates = self.predicates()
            if predicates:
                base = Filter(base, predicates)
            if self.peek()[1] in ("/", "//") and self.peek()[0] == "op":
                return Path(base, collapsed(self.rest_of_steps()))
            return base
        return Path(None, collapsed(self.steps()))

    def starts_primary(self) -> bool:
        kind, value = self.peek()
        if kind in ("num", "str") or (kind == "op" and value in "($"):
            return True
        if kind == "name":
            at = 1
            if self.peek(1) == ("op", ":"):
                at, value = 3, ""
            return self.peek(at) == ("op", "(") and value not in KINDS
        return False

    def starts_step(self) -> bool:
        kind, value = self.peek()
        return kind == "name" or (kind == "op" and value in ("*", "@", ".", ".."))

    def primary(self):
        kind, value = self.peek()
        if kind == "num":
            self.take()
            return Literal(int(value) if re.fullmatch(r"\d+(\.0*)?", value) and "." not in value else float(value))
        if kind == "str":
            self.take()
            return Literal(value[1:-1])
        if self.accept("("):
            inner = self.binary(0)
            self.take(")")
            return inner
        if self.accept("$"):
            return Variable(self.qname())
        name = self.qname()
        self.take("(")
        args = []
        while not self.accept(")"):
            args.append(self.binary(0))
            if self.peek() != ("op", ")"):
                self.take(",")
        return Call(name, tuple(args))

    def qname(self) -> str:
        name = self.take()
        return f"{name}:{self.take()}" if self.accept(":") else name

    def predicates(self) -> tuple:
        out = []
        while self.accept("["):
            out.append(self.binary(0))
            self.take("]")
        return tuple(out)

    def rest_of_steps(self) -> list:
        out = []
        while self.peek()[0] == "op" and self.peek()[1] in ("/", "//"):
            if self.take() == "//":
                out.append(Step("descendant-or-self", Test("node")))
            out.append(self.step())
        return out

    def steps(self) -> list:
        return [self.step(), *self.rest_of_steps()]

    def step(self):
        if self.accept(".."):
            return Step("parent", Test("node"))
        if self.accept("."):
            return Step("self", Test("node"), self.predicates())
        axis = "child"
        if self.accept("@"):
            axis = "attribute"
        elif self.peek(1) == ("op", "::"):
            axis = self.take()
            self.take("::")
            if axis not in AXES:
                raise XPathError(f"no axis {axis!r}")
        return Step(axis, self.test(), self.predicates())

    def test(self) -> Test:
        if self.accept("*"):
            return Test("name", "*", None)
        name = self.take()
        if name in KINDS and self.peek() == ("op", "("):
            self.take("(")
            target = self.take()[1:-1] if self.peek()[0] == "str" else None
            self.take(")")
            return Test(name, target)
        if self.accept(":"):
            return Test("name", "*" if self.accept("*") else self.take(), name)
        return Test("name", name)


def positional(expression) -> bool:
    """Whether a predicate's value may depend on position or size."""
    if isinstance(expression, Literal):
        return not isinstance(expression.value, (str, bool))
    if isinstance(expression, Variable):
        return True
    if isinstance(expression, Call):
        return expression.name in ("position", "last") or expression.name in NUMERIC_CALLS or any(uses_position(a) for a in expression.args)
    if isinstance(expression, Op):
        return expression.name in ("+", "-", "*", "div", "mod", "neg") or any(uses_position(a) for a in expression.args)
    return False


NUMERIC_CALLS = frozenset("number sum count floor ceiling round string-length if".split())


def uses_position(expression) -> bool:
    if isinstance(expression, Call):
        return expression.name in ("position", "last") or any(map(uses_position, expression.args))
    return isinstance(expression, Op) and any(map(uses_position, expression.args))


def collapsed(steps: list) -> tuple:
    """``//x`` is one descendant step unless x's predicates count positions; ``[local-name()='x']`` is a name test."""
    out: list = []
    for step in steps:
        any_node = Step("descendant-or-self", Test("node"))
        if out and out[-1] == any_node and step.axis == "child" and not any(map(positional, step.predicates)):
            out[-1] = Step("descendant", step.test, step.predicates)
        else:
            out.append(step)
    for i, step in enumerate(out):
        if step.test == Test("name", "*", None) and step.predicates:
            p = step.predicates[0]
            if isinstance(p, Op) and p.name == "=" and p.args[0] == Call("local-name") and isinstance(p.args[1], Literal) and isinstance(p.args[1].value, str):
                out[i] = Step(step.axis, Test("name", p.args[1].value, None), step.predicates[1:])
    return tuple(out)


def parse(text: str):
    return Parser(text).parse()


def parse_avt(text: str):
    """An attribute value template: literals and {expressions}, doubled braces for single ones."""
    parts, at, literal = [], 0, ""
    while at < len(text):
        c = text[at]
        if text[at : at + 2] in ("{{", "}}"):
            literal, at = literal + c, at + 2
        elif c == "{":
            end = at + 1
            quote = None
            while end < len(text) and (quote or text[end] != "}"):
                quote = None if quote == text[end] else quote or (text[end] if text[end] in "\"'" else None)
                end += 1
            if end == len(text):
                raise XPathError(f"a brace is not closed in {text!r}")
            if literal:
                parts.append(Literal(literal))
            parts.append(Call("string", (parse(text[at + 1 : end]),)))
            literal, at = "", end + 1
        elif c == "}":
            raise XPathError(f"a brace is not opened in {text!r}")
        else:
            literal, at = literal + c, at + 1
    if literal or not parts:
        parts.append(Literal(literal))
    return parts[0] if len(parts) == 1 else Call("concat", tuple(parts))
