"""Stages. Those made of Columns run inside Catalyst; the others are fused into one Arrow boundary."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame

from recordmill.dsl.compiler import VALIDATE, Compiled, Program
from recordmill.errors import PipelineValidationError
from recordmill.model import DROP, WorkerContext


class Stage:
    """A step on one record. Each Python worker has a copy of its own, set up once."""

    def __init__(self, name: str | None = None) -> None:
        self.given_name = name
        self.name = name or type(self).__name__

    def setup(self, context: WorkerContext) -> None:
        """Runs in each worker before its first record."""

    def process(self, value: Any, context: WorkerContext) -> Any:
        raise NotImplementedError

    def teardown(self, context: WorkerContext) -> None:
        """Runs when a worker ends, if it ends in order."""

    def native(self, df: DataFrame) -> DataFrame | None:
        """The step on a DataFrame of typed columns, or None if only Python can do it."""
        return None


class GenericStage(Stage):
    """``output(process(input(x)))``; DROP from any of them drops. With ``with_context`` all take the context too."""

    def __init__(
        self, *, process: Callable, input: Callable | None = None, output: Callable | None = None, setup: Callable | None = None, teardown: Callable | None = None, name: str | None = None, with_context: bool = False
    ) -> None:
        super().__init__(name)
        for part in (process, input, output, setup, teardown):
            if part is not None and not callable(part):
                raise PipelineValidationError(f"not callable: {part!r}")
        self.parts = [p for p in (input, process, output) if p is not None]
        self.on_setup, self.on_teardown, self.with_context = setup, teardown, with_context

    def _call(self, f: Callable | None, context: WorkerContext) -> None:
        if f is not None:
            f(context) if self.with_context else f()

    def setup(self, context: WorkerContext) -> None:
        self._call(self.on_setup, context)

    def teardown(self, context: WorkerContext) -> None:
        self._call(self.on_teardown, context)

    def process(self, value: Any, context: WorkerContext) -> Any:
        for f in self.parts:
            value = f(value, context) if self.with_context else f(value)
            if value is DROP:
                break
        return value


class TransformStage(Stage):
    """``x -> fn(x)``; given a mapping of names to Columns instead, it sets those columns natively."""

    def __init__(self, fn: Callable[[Any], Any] | Mapping[str, Column], name: str | None = None) -> None:
        super().__init__(name or getattr(fn, "__name__", None))
        self.given_name = name
        self.fn = fn

    def process(self, value: Any, context: WorkerContext) -> Any:
        return self.fn(value)

    def native(self, df: DataFrame) -> DataFrame | None:
        return df.withColumns(dict(self.fn)) if isinstance(self.fn, Mapping) else None


class FilterStage(Stage):
    """Keeps what the predicate finds true, as Python does; a Column keeps what is true, not null."""

    def __init__(self, predicate: Callable[[Any], Any] | Column, name: str | None = None) -> None:
        super().__init__(name or getattr(predicate, "__name__", None) if not isinstance(predicate, Column) else name)
        self.given_name = name
        self.predicate = predicate

    def process(self, value: Any, context: WorkerContext) -> Any:
        return value if self.predicate(value) else DROP

    def native(self, df: DataFrame) -> DataFrame | None:
        return df.filter(self.predicate) if isinstance(self.predicate, Column) else None


class TapStage(Stage):
    """Calls ``fn`` and passes the value on. A task that runs again calls it again."""

    def __init__(self, fn: Callable[[Any], Any], name: str | None = None) -> None:
        super().__init__(name or getattr(fn, "__name__", None))
        self.given_name = name
        self.fn = fn

    def process(self, value: Any, context: WorkerContext) -> Any:
        self.fn(value)
        return value


class JsonLoadStage(Stage):
    def __init__(self, loads: Callable[[str], Any] = json.loads, name: str | None = None) -> None:
        super().__init__(name)
        self.loads = loads

    def process(self, value: Any, context: WorkerContext) -> Any:
        return self.loads(value)


class JsonDumpStage(Stage):
    def __init__(self, dumps: Callable[[Any], str] = json.dumps, name: str | None = None) -> None:
        super().__init__(name)
        self.dumps = dumps

    def process(self, value: Any, context: WorkerContext) -> Any:
        return self.dumps(value)


class ToolProgramStage(Stage):
    """A compiled expression. Tools of providers are loaded in the worker, from the bytes that travel along."""

    def __init__(self, compiled: Compiled, name: str | None = None, validate: str = "always") -> None:
        super().__init__(name)
        if validate not in VALIDATE:
            raise PipelineValidationError(f"validate is one of {VALIDATE}, not {validate!r}")
        self.compiled, self.validate, self.program = compiled, validate, None

    def setup(self, context: WorkerContext) -> None:
        self.program = Program(self.compiled, self.validate)

    def process(self, value: Any, context: WorkerContext) -> Any:
        return self.program(value, context.record_index)


def as_stage(x: Any) -> Stage:
    if isinstance(x, Stage):
        return x
    if callable(x):
        return TransformStage(x)
    raise PipelineValidationError(f"neither a stage nor callable: {x!r}")


def named(stages: list[Stage]) -> list[Stage]:
    """The stages with names of their own: given ones must differ, others get a number where they don't."""
    given = [s.given_name for s in stages if s.given_name]
    if len(set(given)) < len(given):
        raise PipelineValidationError(f"stage names come twice: {sorted({n for n in given if given.count(n) > 1})}")
    used = set(given)
    for s in stages:
        if not s.given_name:
            base, k = s.name, 2
            while s.name in used:
                s.name, k = f"{base}_{k}", k + 1
            used.add(s.name)
    return stages
