"""Formulas: parsing, canonical form up to bound names, hash, display."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import spread

# Binding strength of infix operators.
INFIX = {"↔": 10, "→": 20, "∨": 30, "∧": 40, **dict.fromkeys(("=", "≠", "<", "≤", ">", "≥", "∈", "∉", "⊆", "⊂"), 50), "+": 60, "-": 60, "*": 70, "/": 70, "^": 80}
RIGHT = {"→", "^"}
SPELLED = {"<->": "↔", "->": "→", "/\\": "∧", "\\/": "∨", "!=": "≠", "<=": "≤", ">=": "≥"}
BINDERS = {"∀": "P", "∃": "E", "λ": "L", "fun": "L"}
UNARY = {"¬": 45, "-": 75}
MARKS = {"P": "∀", "E": "∃", "L": "λ"}
_TOKEN = re.compile(r"\s*(<->|->|/\\|\\/|!=|<=|>=|:=|=>|↦|[0-9]+(?:\.[0-9]+)?|[^\W\d][\w'.]*|\S)")
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def run(step: Generator):
    """The result of a function that yields the calls that it waits for; the calls stand on a list, not on Python's stack."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


@dataclass
class Node:
    """kind: var, const, lit, app, bind or unparsed; value: its name; parts: what it holds."""

    kind: str
    value: str
    parts: list[Node] = field(default_factory=list)
    names: list[tuple[str, Node | None]] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str):
        self.tokens = [SPELLED.get(t, t) for t in _TOKEN.findall(text)]
        self.at, self.bound = 0, []

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def expression(self, least: int = 0) -> Generator:
        left = yield self.prefix()
        while left and (op := self.peek()) in INFIX and INFIX[op] >= max(least, 1):
            start = self.at
            self.next()
            right = yield self.expression(INFIX[op] + (op not in RIGHT))
            if right is None:
                self.at = start
                break
            left = Node("app", op, [left, right])
        return left

    def prefix(self) -> Generator:
        token = self.peek()
        if token in UNARY:
            self.next()
            inner = yield self.expression(UNARY[token])
            return Node("app", token, [inner]) if inner else None
        if token in BINDERS:
            return (yield self.binder())
        head = yield self.atom()
        if head is None:
            return None
        parts = []
        while (nxt := self.peek()) and nxt not in INFIX and nxt not in BINDERS and (part := (yield self.atom())):
            parts.append(part)
        return Node("app", "", [head, *parts]) if parts else head

    def atom(self) -> Generator:
        token = self.peek()
        if token == "(":
            start = self.at
            self.next()
            inner = yield self.expression()
            if inner and self.peek() == ")":
                self.next()
                return inner
            self.at = start
            return None
        if token is None or token in INFIX or token in BINDERS or token in UNARY:
            return None
        if re.match(r"[0-9]", token):
            return Node("lit", self.next())
        if re.match(r"[^\W\d]", token):
            name = self.next()
            return Node("var" if name in self.bound else "const", name)
        return None

    def binder(self) -> Generator:
        mark = self.next()
        names: list[tuple[str, Node | None]] = []
        depth = len(self.bound)
        while (token := self.peek()) not in (",", "=>", "↦", None):
            if token in "({[":
                self.next()
                own = self.names()
                kind = (yield self.expression()) if self.peek() == ":" and self.next() else None
                if self.peek() in (")", "}", "]"):
                    self.next()
            else:
                own = self.names()
                kind = (yield self.expression()) if self.peek() == ":" and self.next() else None
            if not own:
                break
            names += [(n, kind) for n in own]
            self.bound += own
        if self.peek() in (",", "=>", "↦"):
            self.next()
        body = yield self.expression()
        del self.bound[depth:]
        return Node("bind", BINDERS[mark], [body], names) if body and names else None

    def names(self) -> list[str]:
        out = []
        while (token := self.peek()) and re.fullmatch(r"[^\W\d][\w'.]*", token):
            out.append(self.next())
        return out


def parse(text: str) -> tuple[Node, str]:
    """P-01: (formula, status); what can't be read is kept as text and the status is partial, or failed if nothing can."""
    reader = _Reader(text or "")
    node = run(reader.expression())
    rest = " ".join(reader.tokens[reader.at :])
    if node is None:
        return Node("unparsed", (text or "").strip()), "failed"
    return (Node("app", "", [node, Node("unparsed", rest)]), "partial") if rest else (node, "full")


def canonical(node: Node) -> str:
    """P-02: a form in which bound names are numbers, counted from the innermost binder."""
    return run(_canonical(node, ()))


def _canonical(node: Node, bound: tuple[str, ...]) -> Generator:
    if node.kind == "var" and node.value in bound:
        return f"#{bound[::-1].index(node.value)}"
    if node.kind in ("var", "const", "lit", "unparsed"):
        return f"{'C' if node.kind in ('var', 'const') else node.kind[0].upper()}{len(node.value.encode())}:{node.value}"
    if node.kind == "app":
        head = [f"C{len(node.value.encode())}:{node.value}"] if node.value else []
        for p in node.parts:
            head.append((yield _canonical(p, bound)))
        return f"({' '.join(head)})"
    kinds = ""
    for name, kind in node.names:
        kinds += ((yield _canonical(kind, bound)) if kind else "_") + ";"
        bound = (*bound, name)
    body = yield _canonical(node.parts[0], bound)
    return f"{node.value}[{kinds}]{body}"


def fnv1a(data: bytes) -> str:
    """The 64-bit FNV-1a hash in hexadecimal."""
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def display(node: Node) -> str:
    """P-03: infix with brackets, application by juxtaposition."""
    return run(_display(node))


def _display(node: Node) -> Generator:
    if node.kind == "unparsed":
        return f"«{node.value}»"
    if node.kind not in ("bind", "app"):
        return node.value
    parts = []
    for p in node.parts:
        parts.append((yield _display(p)))
    if node.kind == "bind":
        names = []
        for n, k in node.names:
            names.append(f"({n} : {(yield _display(k))})" if k else n)
        return f"{MARKS[node.value]} {' '.join(names)}, {parts[0]}"
    if node.value:
        return f"({parts[0]} {node.value} {parts[1]})" if len(parts) == 2 else f"{node.value}{parts[0]}"
    held = lambda p: p.kind == "bind" or (p.kind == "app" and not p.value)
    return " ".join([parts[0], *(f"({x})" if held(p) else x for p, x in zip(node.parts[1:], parts[1:], strict=True))])


def parsed(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """P-01..P-03: ``keep`` and (canonical, hash, display, status) of a column of formulas, an Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [parse(t) for t in pdf["__t"]]
            forms = [canonical(n) for n, _ in done]
            yield pdf.drop(columns="__t").assign(canonical=forms, hash=[fnv1a(c.encode()) for c in forms], display=[display(n) for n, _ in done], status=[s for _, s in done])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, F.col(text).cast("string").alias("__t"))).mapInPandas(run, f"{own}, canonical string, hash string, display string, status string")
