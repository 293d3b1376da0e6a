"""From text to calls: one pattern finds the tokens, a recursive descent reads them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from recordmill.dsl.errors import ExpressionSyntaxError, Span

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<number>-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<mark>[|().\[\]{},:=])""",
    re.S,
)
# Escapes with a meaning of their own, and words for constants.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


@dataclass(frozen=True)
class Step:
    """Part of a selector: a key (str), an index (int) or every element (None)."""

    key: str | int | None


@dataclass(frozen=True)
class Call:
    name: str
    selector: tuple[Step, ...]
    arguments: tuple[tuple[str, Any, Span], ...]
    span: Span
    selector_span: Span


class Reader:
    def __init__(self, text: str) -> None:
        self.text, self.k = text, 0
        self.tokens: list[tuple[str, str, Span]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                what = "this text has no end" if text[at] in "\"'" else f"unexpected {text[at]!r}"
                raise ExpressionSyntaxError(what, text, Span(at, at + 1))
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], Span(*m.span())))
            at = m.end()
        self.tokens.append(("end", "", Span(len(text), len(text))))

    def fail(self, wanted: str) -> ExpressionSyntaxError:
        kind, word, span = self.tokens[self.k]
        return ExpressionSyntaxError(f"{wanted} is expected here" + (f", not {word!r}" if kind != "end" else ""), self.text, span)

    def at(self, word: str, ahead: int = 0) -> bool:
        kind, got, _ = self.tokens[min(self.k + ahead, len(self.tokens) - 1)]
        return kind == "mark" and got == word

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.k + ahead, len(self.tokens) - 1)][0]

    def take(self) -> tuple[str, Span]:
        _, word, span = self.tokens[self.k]
        self.k += 1
        return word, span

    def want(self, word: str) -> Span:
        if not self.at(word):
            raise self.fail(repr(word))
        return self.take()[1]

    def program(self) -> list[Call]:
        calls = [self.call()]
        while self.at("|"):
            self.take()
            calls.append(self.call())
        if self.kind() != "end":
            raise self.fail("'|' or the end")
        return calls

    def call(self) -> Call:
        if self.kind() != "name":
            raise self.fail("a tool's name")
        name, first = self.take()
        if self.at(".") and self.kind(1) == "name" and self.at("(", 2):
            self.take()
            name += "." + self.take()[0]
        self.want("(")
        begin = self.tokens[self.k][2].start
        selector = self.selector()
        selected = Span(begin, self.tokens[self.k - 1][2].end)
        arguments = []
        while self.at(","):
            self.take()
            if self.kind() != "name":
                raise self.fail("an argument's name")
            key, span = self.take()
            self.want("=")
            value = self.literal()
            arguments.append((key, value, Span(span.start, self.tokens[self.k - 1][2].end)))
        last = self.want(")")
        return Call(name, selector, tuple(arguments), Span(first.start, last.end), selected)

    def selector(self) -> tuple[Step, ...]:
        if not self.at("."):
            raise self.fail("a selector, which begins with '.'")
        self.take()
        steps = []
        if self.kind() == "name":
            steps.append(Step(self.take()[0]))
        while True:
            if self.at("."):
                self.take()
                if self.kind() != "name":
                    raise self.fail("a field's name")
                steps.append(Step(self.take()[0]))
            elif self.at("["):
                self.take()
                if self.kind() == "text":
                    steps.append(Step(unquoted(self.take()[0])))
                elif self.kind() == "number":
                    word, span = self.take()
                    if not re.fullmatch(r"-?[0-9]+", word):
                        raise ExpressionSyntaxError("an index is a whole number", self.text, span)
                    steps.append(Step(int(word)))
                else:
                    steps.append(Step(None))
                self.want("]")
            else:
                return tuple(steps)

    def literal(self) -> Any:
        kind = self.kind()
        if kind == "text":
            return unquoted(self.take()[0])
        if kind == "number":
            word = self.take()[0]
            return int(word) if re.fullmatch(r"-?[0-9]+", word) else float(word)
        if kind == "name" and self.tokens[self.k][1] in CONSTANTS:
            return CONSTANTS[self.take()[0]]
        if self.at("["):
            return [v for _, v in self._items("[", "]", keyed=False)]
        if self.at("{"):
            return dict(self._items("{", "}", keyed=True))
        raise self.fail("a literal")

    def _items(self, first: str, last: str, *, keyed: bool) -> list[tuple[str, Any]]:
        self.want(first)
        out: list[tuple[str, Any]] = []
        while not self.at(last):
            if out:
                self.want(",")
            key = ""
            if keyed:
                if self.kind() != "text":
                    raise self.fail("a key in quotes")
                key = unquoted(self.take()[0])
                self.want(":")
            out.append((key, self.literal()))
        self.want(last)
        return out


def unquoted(word: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S)


def parse(text: str) -> list[Call]:
    return Reader(text).program()


def rendered(selector: tuple[Step, ...]) -> str:
    """A selector as text: fields with dots where they are names, the rest in brackets."""
    import json

    out = ""
    for s in selector:
        if isinstance(s.key, str) and re.fullmatch(r"[^\W\d]\w*", s.key):
            out += f".{s.key}"
        else:
            out += ("." if not out else "") + ("[]" if s.key is None else f"[{json.dumps(s.key, ensure_ascii=False)}]")
    return out or "."
