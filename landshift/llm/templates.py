"""A small template language for conversations, compiled to Python closures.

    text    {{ expr }}    {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% for message in messages %} .. {% endfor %}    {% generation %} .. {% endgeneration %}

Expressions: strings, ``true``, ``false``, ``none``, names given as constants, ``message.role``, ``message['text']``,
``loop.first``, ``loop.last``; ``==  !=  in  not  and  or  +``, parentheses, and the filters below.

It is a sandbox: names are looked up in what the template is given, fields in a message, and nothing else can be
reached: no calls, no attributes of Python objects, no loops but the one over the messages, no assignment. Source and nesting are
bounded, so rendering takes time in proportion to its output.

A template is a head, one loop over the messages and a tail, so a conversation can be rendered message by message,
in parts, wherever they are. Compilation folds what is constant -- joined strings, comparisons, filters of
constants, branches that cannot be taken, neighbouring texts -- and makes a closure of each node that is left. A
closure appends to the output; ``generation`` notes where its output begins and ends, in code points.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Mapping

MOST_SOURCE = 100_000
MOST_DEPTH = 50

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[|+().\[\]]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that cannot be compiled."""


@dataclasses.dataclass(frozen=True)
class Node:
    """A node of the syntax tree: its kind, a value for leaves, and its parts."""

    kind: str
    value: object = None
    parts: tuple = ()


class Output:
    """What is rendered so far, its length, and the spans of generated text."""

    __slots__ = ("parts", "size", "spans")

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def text(self) -> str:
        return "".join(self.parts)


# Parsing.


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(source.rstrip())
        while at < end:
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.tokens.append(next((k, g) for k, g in zip(("text", "name", "sign"), m.groups(), strict=True) if g is not None))
            at = m.end()
        self.at = self.depth = 0

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _take(self, *signs: str) -> str | None:
        kind, value = self._peek()
        if kind != "text" and value in signs:
            self.at += 1
            return value
        return None

    def _need(self, sign: str) -> None:
        if not self._take(sign):
            raise TemplateError(f"{sign!r} expected, found {self._peek()[1]!r}")

    def _word(self) -> str:
        kind, value = self._peek()
        if kind != "name":
            raise TemplateError(f"a name expected, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self._or()
        if self._peek()[0] != "end":
            raise TemplateError(f"unexpected {self._peek()[1]!r}")
        return node

    def _or(self) -> Node:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        node = self._and()
        while self._take("or"):
            node = Node("or", parts=(node, self._and()))
        self.depth -= 1
        return node

    def _and(self) -> Node:
        node = self._not()
        while self._take("and"):
            node = Node("and", parts=(node, self._not()))
        return node

    def _not(self) -> Node:
        turns = 0
        while self._take("not"):
            turns += 1
        node = self._compared()
        return Node("not", parts=(node if turns % 2 else Node("not", parts=(node,)),)) if turns else node

    def _compared(self) -> Node:
        node = self._sum()
        while sign := self._take("==", "!=", "in"):
            node = Node(sign, parts=(node, self._sum()))
        return node

    def _sum(self) -> Node:
        node = self._filtered()
        while self._take("+"):
            node = Node("+", parts=(node, self._filtered()))
        return node

    def _filtered(self) -> Node:
        node = self._atom()
        while self._take("|"):
            node = Node("filter", self._word(), (node,))
        return node

    def _atom(self) -> Node:
        if self._take("("):
            node = self._or()
            self._need(")")
            return node
        kind, value = self._peek()
        self.at += 1
        if kind == "text":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind != "name":
            raise TemplateError(f"a value expected, found {value!r}")
        if value in ("true", "false", "none"):
            return Node("const", {"true": True, "false": False, "none": None}[value])
        if self._take("."):
            return Node("field", (value, self._word()))
        if self._take("["):
            kind, key = self._peek()
            if kind != "text":
                raise TemplateError("a field's name expected")
            self.at += 1
            self._need("]")
            return Node("field", (value, key[1:-1]))
        return Node("name", value)


def parsed(source: str) -> Node:
    """The syntax tree of a template: a sequence of text, output, if, for and generation nodes."""
    if len(source) > MOST_SOURCE:
        raise TemplateError("the template is too long")
    stack: list[tuple[str, list, object]] = [("", [], None)]
    at = 0

    def close(kind: str) -> tuple[list, object]:
        if stack[-1][0] != kind:
            raise TemplateError(f"end of {kind!r} without its begin")
        _, parts, extra = stack.pop()
        return parts, extra

    def add(node: Node) -> None:
        stack[-1][1].append(node)

    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if m and source.startswith("-", m.start() + 2):
            text = text.rstrip()
        if at and source[at - 3 : at - 2] == "-":
            text = text.lstrip()
        if text:
            add(Node("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            add(Node("output", parts=(_Expression(m[1]).whole(),)))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if len(stack) > MOST_DEPTH:
                raise TemplateError("nested too deeply")
            if word == "if":
                stack.append(("if", [], [_Expression(rest).whole()]))
            elif word in ("elif", "else"):
                parts, tests = close("if")
                if not isinstance(tests, list) or tests[-1] is None:
                    raise TemplateError(f"{word!r} after 'else'")
                tests += [parts, _Expression(rest).whole() if word == "elif" else None]
                stack.append(("if", [], tests))
            elif word == "endif":
                parts, tests = close("if")
                node = Node("seq")
                branches = [*tests, parts]
                for test, body in reversed(list(zip(branches[::2], branches[1::2], strict=True))):
                    own = Node("seq", parts=tuple(body))
                    node = own if test is None else Node("if", parts=(test, own, node))
                add(node)
            elif word == "for":
                name, loop = re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip()), len(stack) == 1
                if not name or not loop:
                    raise TemplateError("only 'for <name> in messages', outside of all other tags")
                stack.append(("for", [], name[1]))
            elif word == "endfor":
                parts, name = close("for")
                add(Node("for", name, tuple(parts)))
            elif word == "generation":
                if any(kind == "generation" for kind, _, _ in stack):
                    raise TemplateError("generation within generation")
                stack.append(("generation", [], None))
            elif word == "endgeneration":
                add(Node("generation", parts=tuple(close("generation")[0])))
            else:
                raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is never closed")
    return Node("seq", parts=tuple(stack[0][1]))


# Folding.


def _shown(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _within(a: object, b: object) -> bool:
    return _shown(a) in b if isinstance(b, str) else a in b if isinstance(b, tuple) else False


_OF_TWO: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _within, "+": lambda a, b: _shown(a) + _shown(b)}


def folded(node: Node, constants: Mapping[str, object], filters: Mapping[str, Callable[[str], str]]) -> Node:
    """The tree with everything computed that does not depend on the messages."""
    parts = tuple(folded(p, constants, filters) for p in node.parts)
    fixed = [p.kind == "const" for p in parts]
    if node.kind == "name":
        if node.value not in constants:
            raise TemplateError(f"unknown name {node.value!r}")
        return Node("const", constants[node.value])
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        return Node("const", filters[node.value](_shown(parts[0].value))) if fixed[0] else Node("filter", node.value, parts)
    if node.kind in _OF_TWO and all(fixed):
        return Node("const", _OF_TWO[node.kind](parts[0].value, parts[1].value))
    if node.kind == "not" and fixed[0]:
        return Node("const", not parts[0].value)
    if node.kind in ("and", "or") and fixed[0]:
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if node.kind == "output" and fixed[0]:
        return Node("text", _shown(parts[0].value))
    if node.kind == "if" and fixed[0]:
        return parts[1] if parts[0].value else parts[2]
    if node.kind in ("seq", "for", "generation"):
        return Node(node.kind, node.value, _merged(parts))
    return Node(node.kind, node.value, parts)


def _merged(parts: tuple) -> tuple:
    """Sequences within a sequence laid open, neighbouring texts joined, empty ones dropped."""
    out: list[Node] = []
    for p in parts:
        for q in p.parts if p.kind == "seq" else (p,):
            if q.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + q.value)
            elif q.kind != "text" or q.value:
                out.append(q)
    return tuple(out)


# Closures. Expressions take (message, first, last); statements the output as well.


def _value(node: Node, name: str | None, filters: Mapping[str, Callable[[str], str]], fields: frozenset[str]) -> Callable:
    if node.kind == "const":
        return lambda message, first, last, value=node.value: value
    if node.kind == "field":
        of, field = node.value
        if name is None or of not in (name, "loop"):
            raise TemplateError(f"unknown name {of!r}")
        if of == "loop":
            if field not in ("first", "last"):
                raise TemplateError(f"loop has no {field!r}")
            return (lambda message, first, last: first) if field == "first" else (lambda message, first, last: last)
        if field not in fields:
            raise TemplateError(f"a message has no {field!r}")
        return lambda message, first, last: message[field]
    parts = [_value(p, name, filters, fields) for p in node.parts]
    a = parts[0]
    if node.kind == "filter":
        run = filters[node.value]
        return lambda message, first, last: run(_shown(a(message, first, last)))
    if node.kind == "not":
        return lambda message, first, last: not a(message, first, last)
    b = parts[1]
    if node.kind == "and":
        return lambda message, first, last: a(message, first, last) and b(message, first, last)
    if node.kind == "or":
        return lambda message, first, last: a(message, first, last) or b(message, first, last)
    both = _OF_TWO[node.kind]
    return lambda message, first, last: both(a(message, first, last), b(message, first, last))


Statement = Callable[[Output, Mapping[str, str], bool, bool], None]


def _statement(node: Node, name: str | None, filters: Mapping[str, Callable[[str], str]], fields: frozenset[str]) -> Statement:
    def body(parts: tuple) -> Statement:
        runs = [_statement(p, name, filters, fields) for p in parts]
        if len(runs) == 1:
            return runs[0]

        def all_of(out, message, first, last):
            for run in runs:
                run(out, message, first, last)

        return all_of

    if node.kind == "text":
        text, size = node.value, len(node.value)

        def fixed(out, message, first, last):
            out.parts.append(text)
            out.size += size

        return fixed
    if node.kind == "output":
        value = _value(node.parts[0], name, filters, fields)

        def shown(out, message, first, last):
            text = _shown(value(message, first, last))
            out.parts.append(text)
            out.size += len(text)

        return shown
    if node.kind == "if":
        test, then, other = _value(node.parts[0], name, filters, fields), body((node.parts[1],)), body((node.parts[2],))

        def chosen(out, message, first, last):
            (then if test(message, first, last) else other)(out, message, first, last)

        return chosen
    if node.kind == "generation":
        run = body(node.parts)

        def generated(out, message, first, last):
            begin = out.size
            run(out, message, first, last)
            out.spans.append((begin, out.size))

        return generated
    if node.kind == "seq":
        return body(node.parts)
    raise TemplateError(f"{node.kind!r} is not allowed here")


@dataclasses.dataclass(frozen=True)
class Template:
    """Closures for what stands before the messages, for each message, and after them."""

    tree: Node
    head: Statement
    message: Statement
    tail: Statement

    def render(self, messages: list[Mapping[str, str]]) -> Output:
        """A whole conversation."""
        out = Output()
        self.head(out, {}, False, False)
        for k, m in enumerate(messages):
            self.message(out, m, k == 0, k == len(messages) - 1)
        self.tail(out, {}, False, False)
        return out


def compiled(source: str, constants: Mapping[str, object] | None = None, filters: Mapping[str, Callable[[str], str]] | None = None, fields: frozenset[str] = frozenset({"role", "text"})) -> Template:
    """Parse, fold and turn into closures. ``filters`` are the only functions a template can reach."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **(filters or {})}
    tree = folded(parsed(source), constants or {}, filters)
    loops = [k for k, p in enumerate(tree.parts) if p.kind == "for"]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over the messages")
    at = loops[0]
    loop = tree.parts[at]
    make = lambda parts, name=None: _statement(Node("seq", parts=parts), name, filters, fields)
    return Template(tree, make(tree.parts[:at]), make(loop.parts, loop.value), make(tree.parts[at + 1 :]))
