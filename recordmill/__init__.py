"""Record programs on Spark: pipelines, a jq-like expression language, typed tools, JSONL and Parquet."""

from recordmill.dsl.compiler import compile_expression
from recordmill.functions.types import JsonType, OneOf
from recordmill.model import DROP, ExecutionStats, RuntimeContext, SourceRecordError, TaskResult, WorkerContext
from recordmill.operators.stages import FilterStage, GenericStage, JsonDumpStage, JsonLoadStage, Stage, TapStage, ToolProgramStage, TransformStage
from recordmill.plans.run import Pipeline, ProcessExecutor, SequentialExecutor, ThreadExecutor
from recordmill.sharding import HashSharding, ModuloSharding, NoSharding, RangeSharding, default_sharding_for
from recordmill.sources.jsonl import JsonlSink, JsonlSource
from recordmill.sources.local import CallableSink, IterableSource, ListSink
from recordmill.sources.parquet import ParquetSink, ParquetSource
from recordmill.tools.contract import Example, tool

__version__ = "0.1.0"
__all__ = [
    "DROP", "CallableSink", "Example", "ExecutionStats", "FilterStage", "GenericStage", "HashSharding", "IterableSource", "JsonDumpStage", "JsonLoadStage",
    "JsonType", "JsonlSink", "JsonlSource", "ListSink", "ModuloSharding", "NoSharding", "OneOf", "ParquetSink", "ParquetSource", "Pipeline",
    "ProcessExecutor", "RangeSharding", "RuntimeContext", "SequentialExecutor", "SourceRecordError", "Stage", "TapStage", "TaskResult", "ThreadExecutor",
    "ToolProgramStage", "TransformStage", "WorkerContext", "compile_expression", "default_sharding_for", "tool",
]
