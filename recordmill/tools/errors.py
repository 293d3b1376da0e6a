"""What went wrong in a tool call on a record."""

from __future__ import annotations

from typing import Any

FIELDS = ("invocation_index", "tool_name", "provider_id", "expression_span", "selector", "matched_path", "match_ordinal", "expected_type", "actual_type", "stage")


class ToolExecutionError(Exception):
    """``stage`` is selector, input, call or output; the other FIELDS say where and what."""

    def __init__(self, *, cause: BaseException | None = None, record_seq: int | None = None, **fields: Any) -> None:
        for f in FIELDS:
            setattr(self, f, fields.get(f))
        self.cause, self.record_seq = cause, record_seq
        where = f"{self.tool_name}({self.selector})" + (f" at {self.matched_path}" if self.matched_path else "")
        if self.stage in ("input", "output"):
            what = f"{self.stage} is {self.actual_type}, not {self.expected_type}"
        else:
            what = f"{type(cause).__name__}: {cause}" if cause else "failed"
        super().__init__(f"{where}, {self.stage}: {what}")

    def fields(self) -> dict[str, Any]:
        return {f: list(v) if isinstance(v := getattr(self, f), tuple) else v for f in FIELDS}
