"""Errors of expressions, with the place marked."""

from __future__ import annotations

from typing import NamedTuple


class Span(NamedTuple):
    start: int
    end: int


class ExpressionError(Exception):
    def __init__(self, message: str, expression: str = "", span: Span | None = None) -> None:
        self.message, self.expression, self.span = message, expression, span
        super().__init__(marked(expression, span, message) if span is not None else message)


class ExpressionSyntaxError(ExpressionError):
    """The text isn't an expression."""


class ToolResolutionError(ExpressionError):
    """No tool of this name, or more than one."""


class ToolConfigurationError(ExpressionError):
    """Arguments, selectors or neighbours that don't suit a tool."""


class SelectorResolutionError(Exception):
    """A selector finds nothing in a record."""


def marked(expression: str, span: Span, message: str) -> str:
    """The line of the place, carets under it, and the message."""
    first = expression.rfind("\n", 0, span.start) + 1
    last = expression.find("\n", span.start)
    line = expression[first : last if last >= 0 else len(expression)]
    width = max(1, min(span.end, first + len(line)) - span.start)
    return f"{message}\n  {line}\n  {' ' * (span.start - first)}{'^' * width}"
