"""Command line: run, inspect, transform, inspect-expression, tools; an expression alone means transform."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import logging
import os
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from recordmill import __version__
from recordmill.dsl.compiler import VALIDATE, compile_expression, programs
from recordmill.dsl.errors import ExpressionError
from recordmill.errors import RecordmillError
from recordmill.model import RuntimeContext
from recordmill.operators.stages import JsonDumpStage, JsonLoadStage, ToolProgramStage
from recordmill.plans.run import POLICIES, Pipeline, SequentialExecutor, ThreadExecutor, report
from recordmill.sources.base import split_format
from recordmill.sources.jsonl import JsonlSink, JsonlSource
from recordmill.sources.parquet import ParquetSink, ParquetSource
from recordmill.tools.provider import ProviderError, check
from recordmill.tools.registry import Registry

COMMANDS = ("run", "inspect", "transform", "inspect-expression", "tools", "install")


def load_pipeline(text: str) -> Pipeline:
    """The pipeline that ``module:name`` or ``file.py:name`` says."""
    place, colon, name = text.rpartition(":")
    if not colon:
        raise RecordmillError(f"not MODULE:NAME: {text!r}")
    if place.endswith(".py"):
        spec = importlib.util.spec_from_file_location(Path(place).stem, place)
        if spec is None or not Path(place).exists():
            raise RecordmillError(f"no file {place}")
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(place)
    found: Any = module
    for part in name.split("."):
        if not hasattr(found, part):
            raise RecordmillError(f"{place} has no {name!r}")
        found = getattr(found, part)
    if not isinstance(found, Pipeline):
        raise RecordmillError(f"{text} is a {type(found).__name__}, not a Pipeline")
    return found


def source_of(text: str, raw: bool = False) -> JsonlSource | ParquetSource:
    kind, path = split_format(text)
    return ParquetSource(path) if kind == "parquet" else JsonlSource(path, raw=raw)


def sink_of(text: str, raw: bool = False) -> JsonlSink | ParquetSink:
    kind, path = split_format(text)
    return ParquetSink(path) if kind == "parquet" else JsonlSink(path, raw=raw)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="recordmill", description="Record programs on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def running(p: argparse.ArgumentParser) -> None:
        p.add_argument("--errors", choices=POLICIES, default="raise")
        p.add_argument("--error-output")
        order = p.add_mutually_exclusive_group()
        order.add_argument("--ordered", dest="ordered", action="store_true", default=True)
        order.add_argument("--unordered", dest="ordered", action="store_false")
        bar = p.add_mutually_exclusive_group()
        bar.add_argument("--progress", dest="progress", action="store_true", default=True)
        bar.add_argument("--no-progress", dest="progress", action="store_false")
        p.add_argument("--rank", type=int)
        p.add_argument("--world-size", type=int)
        p.add_argument("--local-rank", type=int)
        p.add_argument("--executor", choices=("process", "thread", "sequential"), default="process")
        p.add_argument("--workers", type=int)
        p.add_argument("--max-in-flight", type=int)

    p = sub.add_parser("run", help="run a pipeline")
    p.add_argument("pipeline", help="MODULE:NAME or FILE.py:NAME")
    p.add_argument("--source", "--input", required=True, help="[FORMAT:]PATH")
    p.add_argument("--sink", "--output", required=True, help="[FORMAT:]PATH")
    p.add_argument("--raw", action="store_true", help="JSON lines are taken and written as they are, for pipelines that load and dump them")
    running(p)
    p = sub.add_parser("inspect", help="list a pipeline's stages")
    p.add_argument("pipeline")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("transform", help="apply an expression to JSON lines")
    p.add_argument("expression")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--validate-tools", "--validate", dest="validate", choices=VALIDATE, default="always")
    p.add_argument("--input-format", choices=("jsonl",), default="jsonl")
    p.add_argument("--output-format", choices=("jsonl",), default="jsonl")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--json", action="store_true")
    running(p)
    p = sub.add_parser("inspect-expression", help="compile an expression and describe it")
    p.add_argument("expression")
    p.add_argument("--json", action="store_true")
    p.add_argument("--validate-tools", dest="validate", choices=VALIDATE, default="always")

    def installing(p: argparse.ArgumentParser) -> None:
        p.add_argument("file")
        p.add_argument("--id")
        p.add_argument("--alias")
        p.add_argument("--editable", action="store_true")
        p.add_argument("--force", action="store_true")
        p.add_argument("--yes", action="store_true")

    installing(sub.add_parser("install", help="tools install"))
    tools = sub.add_parser("tools", help="providers of tools").add_subparsers(dest="action", required=True)
    installing(tools.add_parser("install"))
    tools.add_parser("validate").add_argument("file")
    tools.add_parser("list").add_argument("--json", action="store_true")
    tools.add_parser("inspect").add_argument("name")
    tools.add_parser("remove").add_argument("id")
    return top


def _run(pipeline: Pipeline, source: Any, sink: Any, a: argparse.Namespace, error_sink: Any) -> int:
    executor = SequentialExecutor() if a.executor == "sequential" else ThreadExecutor(a.workers, a.max_in_flight)
    runtime = RuntimeContext.auto(rank=a.rank, world_size=a.world_size, local_rank=a.local_rank)
    stats = pipeline.run(source, sink, executor=executor, ordered=a.ordered, errors=a.errors, error_sink=error_sink, max_in_flight=a.max_in_flight, runtime=runtime, progress=a.progress)
    print(
        f"completed={stats.completed_records} failed={stats.failed_records} dropped={stats.dropped_records} elapsed={stats.elapsed_seconds:.2f}s rate={stats.records_per_second:.0f} rec/s",
        file=sys.stderr,
    )
    return 0


def _tools(a: argparse.Namespace) -> int:
    registry = Registry()
    action = "install" if a.command == "install" else a.action
    if action == "install":
        ask = None if a.yes else lambda text: input(f"{text} [y/N] ").strip().lower() in ("y", "yes")
        p = registry.install(a.file, provider_id=a.id, alias=a.alias, editable=a.editable, force=a.force, confirm=ask)
        print(f"installed {p.provider_id} as {p.alias}: {', '.join(t.name for t in p.tools)}")
    elif action == "validate":
        print(f"valid: {', '.join(t.name for t in check(a.file)[1])}")
    elif action == "remove":
        registry.remove(a.id)
        print(f"removed {a.id}")
    elif action == "list":
        rows = [{"provider": "builtin", "alias": "", "tools": sorted(n for n, r in registry.names().items() if r.provider_id == "builtin")}]
        rows += [{"provider": p.provider_id, "alias": p.alias, "tools": [t.name for t in p.tools]} for p in registry.providers()]
        print(json.dumps(rows) if a.json else "\n".join(f"{r['provider']}: {', '.join(r['tools'])}" for r in rows))
    else:
        names = registry.names()
        found = {a.name: names[a.name]} if a.name in names else {n: r for n, r in names.items() if r.provider_id == a.name and "." in n}
        if not found:
            raise RecordmillError(f"neither a provider nor a tool: {a.name!r}")
        print(json.dumps({n: r.contract.to_json() for n, r in found.items()}, indent=1))
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well, 1 on an error, 130 if interrupted."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "transform")
    a = _parser().parse_args(argv)
    logging.basicConfig(level=os.environ.get("RECORDMILL_LOG_LEVEL", "WARNING").upper())
    try:
        if a.command in ("tools", "install"):
            return _tools(a)
        if a.command == "inspect":
            rows = report(load_pipeline(a.pipeline))
            print(json.dumps(rows) if a.json else "\n".join(f"{r['index']}: {r['name']} ({r['kind']})" for r in rows))
            return 0
        if a.command == "run":
            return _run(load_pipeline(a.pipeline), source_of(a.source, a.raw), sink_of(a.sink, a.raw), a, JsonlSink(a.error_output) if a.error_output else None)
        compiled = compile_expression(a.expression)
        if a.command == "inspect-expression" or a.dry_run:
            print(json.dumps(compiled.describe()) if a.json else "\n".join(programs(compiled)))
            return 0
        stages = [JsonLoadStage(), ToolProgramStage(compiled, validate=a.validate), JsonDumpStage()]
        errors = JsonlSink(a.error_output, raw=True) if a.error_output else None
        return _run(Pipeline(stages), JsonlSource(a.input, raw=True), JsonlSink(a.output, raw=True), a, errors)
    except KeyboardInterrupt:
        from pyspark.sql import SparkSession

        if (spark := SparkSession.getActiveSession()) is not None:
            spark.sparkContext.cancelAllJobs()
        return 130
    except (RecordmillError, ExpressionError, ProviderError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
