"""Pipelines: construct, plan, run.

A run hoists the native stages at the front of a typed source, fuses the others into one Arrow boundary and
has one action, unless results are needed twice; then the status rows are written once to scratch and read.
"""

from __future__ import annotations

import contextlib
import json
import logging
import pickle
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordmill.errors import PipelineValidationError, RemoteError, SinkError, StageExecutionError
from recordmill.model import ExecutionStats, ProgressSnapshot, RateTracker, RuntimeContext
from recordmill.operators.stages import Stage, as_stage, named
from recordmill.plans.program import STATUS, RecordProgram, json_line
from recordmill.progress import ProgressReporter, TqdmReporter, Watch
from recordmill.sharding import Sharding, default_sharding_for
from recordmill.sources import files
from recordmill.sources.base import Sink, Source
from recordmill.sources.jsonl import JsonlSink, JsonlSource
from recordmill.sources.local import IterableSource
from recordmill.sources.parquet import ParquetSink, ParquetSource

log = logging.getLogger("recordmill")
POLICIES = ("raise", "skip", "return")


class Executor:
    """Kept so that programs with one go on to work: Spark's tasks run the stages whichever is named."""

    def __init__(self, workers: int | None = None, max_in_flight: int | None = None) -> None:
        for n in (workers, max_in_flight):
            if n is not None and n < 1:
                raise PipelineValidationError(f"at least 1, not {n}")
        self.workers, self.max_in_flight = workers, max_in_flight


class SequentialExecutor(Executor):
    """One partition, in order."""

    def __init__(self) -> None:
        super().__init__(1)


class ThreadExecutor(Executor):
    pass


class ProcessExecutor(Executor):
    pass


def as_source(x: Any) -> Source:
    if isinstance(x, Source):
        return x
    return JsonlSource(x) if isinstance(x, str) else IterableSource(x)


class Pipeline:
    """Stages in order. Nothing happens until ``run`` or ``results``."""

    def __init__(self, stages: Iterable[Stage | Callable]) -> None:
        self.stages = named([as_stage(s) for s in stages])
        if not self.stages:
            raise PipelineValidationError("a pipeline has at least one stage")

    def __repr__(self) -> str:
        return f"Pipeline([{', '.join(s.name for s in self.stages)}])"

    def plan(
        self, spark: SparkSession, source: Source, encode: Callable[[Any], bytes], runtime: RuntimeContext, sharding: Sharding, partitions: int | None = None, traced: bool = True, tally: tuple | None = None
    ) -> tuple[DataFrame, bool]:
        """STATUS rows, and whether native stages have filtered some before."""
        df, stages, native = source.owned(spark, runtime, sharding), list(self.stages), False
        while source.typed and stages and (after := stages[0].native(df)) is not None:
            df, stages, native = after, stages[1:], True
        if late := [s.name for s in stages if isinstance(getattr(s, "fn", None), dict) or not callable(getattr(s, "predicate", callable))]:
            raise PipelineValidationError(f"stages of Columns come first, on a typed source: {late}")
        if partitions:
            df = df.coalesce(partitions)
        df = df.select("seq", *(f"`{c}`" for c in df.columns if c != "seq"))
        program = RecordProgram(stages, source.decode(df.columns[1:]), encode, runtime.rank, runtime.world_size, traced=traced, tally=tally)
        return df.mapInArrow(program, STATUS), native

    def results(self, spark: SparkSession, source: Any, *, encode: Callable[[Any], bytes] = json_line, runtime: RuntimeContext | None = None, sharding: Sharding | None = None) -> DataFrame:
        """STATUS rows of all records: ``seq``, ``status`` (ok, dropped, error, sink), ``value`` and ``error``.

        Only the sizes of the source's splits are counted at once, for the numbers; the rest is lazy.
        """
        runtime = runtime or RuntimeContext()
        return self.plan(spark, as_source(source), encode, runtime, sharding or default_sharding_for(runtime))[0]

    def run(
        self,
        source: Any,
        sink: Sink,
        *,
        executor: Executor | None = None,
        sharding: Sharding | None = None,
        runtime: RuntimeContext | None = None,
        ordered: bool = True,
        progress: bool = False,
        errors: str = "raise",
        error_sink: Sink | None = None,
        max_in_flight: int | None = None,
        progress_reporter: ProgressReporter | None = None,
        spark: SparkSession | None = None,
    ) -> ExecutionStats:
        """Runs the stages over ``source`` into ``sink`` and counts.

        ``raise`` writes what comes before the first error by ``seq`` and raises it; ``skip`` leaves errors out;
        ``return`` writes them as payloads to ``error_sink``, or into the sink at their place.
        """
        if errors not in POLICIES:
            raise PipelineValidationError(f"errors is one of {POLICIES}, not {errors!r}")
        if max_in_flight is not None and max_in_flight < 1:
            raise PipelineValidationError(f"max_in_flight is at least 1, not {max_in_flight!r}")
        spark = spark or SparkSession.builder.getOrCreate()
        runtime = runtime or RuntimeContext.auto()
        sharding = sharding or default_sharding_for(runtime)
        source = as_source(source)
        clock = RateTracker()
        log.info("from %s to %s, %s, rank %d of %d, errors: %s", described(source), described(sink), type(executor or ProcessExecutor()).__name__, runtime.rank, runtime.world_size, errors)
        stats = ExecutionStats(rank=runtime.rank, world_size=runtime.world_size)
        one = 1 if isinstance(executor, SequentialExecutor) or executor and executor.workers == 1 else None
        opened: list[Sink | Source] = []
        raised: BaseException | None = None
        scratch = watch = None
        reporter = progress_reporter or (TqdmReporter() if progress else None)
        try:
            for s in (source, sink, error_sink):
                if s is not None:
                    s.open(runtime)
                    opened.append(s)
            opened.sort(key=lambda s: (s is error_sink, s is source))  # the order of closing
            if reporter is not None:
                known = source.total(spark) if callable(source.total) else source.total
                watch = Watch(reporter, tuple(spark.sparkContext.accumulator(0) for _ in range(3)), known).__enter__()
            if self._all_native(source, sink):
                self._run_native(spark, source, sink, runtime, stats)
            else:
                rows, native = self.plan(spark, source, sink.encode(), runtime, sharding, one, errors != "skip", watch and watch.tally)
                # A sink of one file is one task's work: it copies results that all tasks have made.
                once = isinstance(sink, JsonlSink) and errors != "raise" and error_sink is None and sink.splits(runtime) and not ordered
                if not once:
                    scratch = files.scratch(spark)
                    rows.write.parquet(scratch)
                    rows = spark.read.schema(STATUS).parquet(scratch)
                self._deliver(rows, once, sink, error_sink, errors, runtime, ordered, stats, source.native(spark, runtime) if native else None)
        except BaseException as e:
            raised = e
            raise
        finally:
            if scratch:
                files.delete(scratch)
            for s in opened:
                try:
                    s.close()
                except Exception:
                    if raised is None:
                        raise
                    log.exception("closing %s failed after another error", type(s).__name__)
            stats.elapsed_seconds, stats.records_per_second = clock.read(stats.completed_records)
            if watch is not None:
                watch.end()
                new = max(0, stats.completed_records - watch.told)
                with contextlib.suppress(Exception):  # a reporter's failure is no run's
                    reporter.update(new, ProgressSnapshot(stats.completed_records, stats.output_records, stats.dropped_records, 0, 0, stats.failed_records, stats.completed_records))
                    reporter.close()
        return stats

    def _all_native(self, source: Source, sink: Sink) -> bool:
        return source.typed and isinstance(sink, ParquetSink) and sink.schema is None and all(isinstance(getattr(s, "fn", None), dict) or hasattr(s, "predicate") and not callable(s.predicate) for s in self.stages)

    def _run_native(self, spark: SparkSession, source: ParquetSource, sink: ParquetSink, runtime: RuntimeContext, stats: ExecutionStats) -> None:
        """Scan, Columns and write under Catalyst alone; no record has a number, as none is asked for."""
        came, went = Observation(), Observation()
        df = source.native(spark, runtime).observe(came, F.count(F.lit(1)).alias("n"))
        for s in self.stages:
            df = s.native(df)
        sink.write_native(df.observe(went, F.count(F.lit(1)).alias("n")), runtime)
        stats.input_records = stats.completed_records = came.get["n"]
        stats.output_records = went.get["n"]
        stats.dropped_records = stats.input_records - stats.output_records

    def _deliver(self, rows: DataFrame, once: bool, sink: Sink, error_sink: Sink | None, errors: str, runtime: RuntimeContext, ordered: bool, stats: ExecutionStats, came: DataFrame | None) -> None:
        """Writes STATUS rows. With ``once`` they are computed by the writing itself, and an observation counts them."""
        first = None
        if not once:
            bad = rows.where("status = 'error' or status = 'sink'").agg(F.min(F.struct("seq", "status", "error")).alias("e")).first()["e"]
            if bad is not None and (errors == "raise" or bad["status"] == "sink"):
                first = bad
                rows = rows.where(F.col("seq") < bad["seq"])
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "dropped", "error", "sink")]
        watched = rows.observe(seen, *counts) if once else rows
        if errors == "return" and error_sink is None:
            written = watched.where("status in ('ok', 'error')").select("seq", F.when(F.col("status") == "ok", F.col("value")).otherwise(_wrapped(sink)).alias("value"))
        else:
            written = watched.where("status = 'ok'").select("seq", "value")
        sink.write_rows(written, runtime, ordered)
        if error_sink is not None and errors == "return":
            error_sink.write_rows(rows.where("status = 'error'").select("seq", _wrapped(error_sink).alias("value")), runtime, ordered)
        got = seen.get if once else rows.agg(*counts).first().asDict()
        stats.completed_records = stats.input_records = got["n"] + (first is not None)
        stats.dropped_records, stats.failed_records = got["dropped"], got["error"] + (first is not None)
        stats.output_records = got["ok"] + (got["error"] if errors == "return" else 0)
        if came is not None:
            more = came.count() - got["n"] if first is None else 0
            stats.input_records = stats.completed_records = stats.completed_records + more
            stats.dropped_records += more
        if got["sink"]:
            raise SinkError(f"the sink can't take {got['sink']} records")
        if first is not None:
            p = json.loads(first["error"])
            remote = RemoteError(p["error_type"], p["error_message"], p["traceback"])
            if first["status"] == "sink":
                raise SinkError(f"record {p['seq']}: {remote}") from remote
            raise StageExecutionError(p["stage_name"], p["seq"], remote) from remote


def _wrapped(sink: Sink) -> Column:
    """The payload in ``error`` as the sink's bytes. A payload is a JSON line already, so that most sinks need no Python."""
    if not isinstance(sink, JsonlSink):
        return F.udf(_payload_pickled, "binary", useArrow=True)("error")
    return F.udf(_payload_raw, "binary", useArrow=True)("error") if sink.raw else F.col("error").cast("binary")


def _payload_raw(text):
    return json.dumps(json.loads(text), ensure_ascii=False).encode() if text else None


def _payload_pickled(text):
    return pickle.dumps(json.loads(text), protocol=5) if text else None


def described(x: Any) -> str:
    """What a log says of a source or sink."""
    return f"{type(x).__name__}({getattr(x, 'path', '')})"


def report(pipeline: Pipeline) -> list[dict[str, Any]]:
    """The stages for people and programs: name, kind, and what an expression compiles to."""
    out = []
    for k, s in enumerate(pipeline.stages):
        row: dict[str, Any] = {"index": k, "name": s.name, "kind": type(s).__name__}
        if hasattr(s, "compiled"):
            row |= {"expression": s.compiled.expression, "invocations": s.compiled.describe()}
        out.append(row)
    return out


__all__ = ["Pipeline", "SequentialExecutor", "ThreadExecutor", "ProcessExecutor", "report"]
