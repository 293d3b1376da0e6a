"""The fused program: what runs between Arrow batches. This module is imported by workers, so its cache is theirs."""

from __future__ import annotations

import atexit
import contextlib
import json
import pickle
import traceback
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext

from recordmill.errors import StageExecutionError, WorkerSetupError
from recordmill.model import DROP, SourceRecordError, WorkerContext
from recordmill.operators.stages import Stage
from recordmill.tools.errors import ToolExecutionError

#: A row for each record: its value as the sink wants it, or what went wrong as a JSON payload.
STATUS = "seq long, status string, value binary, error string"
_SCHEMA = pa.schema([("seq", pa.int64()), ("status", pa.string()), ("value", pa.binary()), ("error", pa.string())])
_READY: dict[str, list[Stage]] = {}


def pickled(x: Any) -> bytes:
    return pickle.dumps(x, protocol=5)


def json_line(x: Any) -> bytes:
    return json.dumps(x).encode()


def raw_line(x: Any) -> bytes:
    """What a raw JSONL sink writes: text or bytes, without the line's end."""
    if isinstance(x, dict) and x.get("__error_payload__") is True:
        x = json.dumps({k: v for k, v in x.items() if k != "__error_payload__"}, ensure_ascii=False)
    if not isinstance(x, (str, bytes)):
        raise TypeError(f"a raw sink takes str or bytes, not {type(x).__name__}")
    data = x.encode() if isinstance(x, str) else bytes(x)
    return data[:-1] if data.endswith(b"\n") else data


def payload(seq: int | None, stage: str | None, error: BaseException, metadata: dict | None = None, traced: bool = True) -> dict[str, Any]:
    """An error as a JSON object."""
    cause = error.cause if isinstance(error, StageExecutionError) and isinstance(error.cause, BaseException) else error
    out = {
        "seq": seq, "error_type": type(cause).__name__, "error_message": str(cause), "traceback": "".join(traceback.format_exception(cause)) if traced else "",
        "stage_name": stage, "metadata": metadata or {},
    }
    if isinstance(cause, ToolExecutionError):
        out["tool"] = cause.fields()
    return out


@dataclass
class RecordProgram:
    """Stages with the way in and out. ``decode`` makes a record of a row's columns, ``encode`` bytes of a result.

    ``traced`` is off where nobody reads the errors; ``tally`` has accumulators of records, drops and errors, for progress.
    """

    stages: list[Stage]
    decode: Callable[[tuple], Any]
    encode: Callable[[Any], bytes]
    rank: int = 0
    world_size: int = 1
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    traced: bool = True
    tally: tuple[Any, Any, Any] | None = None

    def _stages(self, context: WorkerContext) -> list[Stage]:
        """This worker's own copy, set up at its first partition and torn down when the worker ends."""
        if self.key not in _READY:
            for s in self.stages:
                try:
                    s.setup(context)
                except Exception as e:
                    raise WorkerSetupError(f"setup of stage {s.name!r} failed: {type(e).__name__}: {e}") from e
            _READY[self.key] = self.stages

            def end() -> None:
                for s in reversed(_READY.pop(self.key, [])):
                    with contextlib.suppress(Exception):
                        s.teardown(context)

            atexit.register(end)
        return _READY[self.key]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """STATUS rows of batches whose first column is ``seq``."""
        task = TaskContext.get()
        context = WorkerContext(self.rank, self.world_size, worker_id=task.partitionId() if task else 0)
        stages = self._stages(context)
        for s in stages:  # what is counted by worker is counted by partition, so that results don't depend on scheduling
            if getattr(getattr(s, "program", None), "seen", None) is not None:
                s.program.seen = 0
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            rows = [self._one(seq, row, stages, context) for seq, *row in zip(*columns)]
            if self.tally:
                for counter, n in zip(self.tally, (len(rows), sum(r[1] == "dropped" for r in rows), sum(r[1] in ("error", "sink") for r in rows))):
                    counter.add(n)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    def _one(self, seq: int, row: list, stages: list[Stage], context: WorkerContext) -> tuple:
        context.record_index = seq
        try:
            value = self.decode(tuple(row))
        except Exception as e:
            return seq, "error", None, json.dumps(payload(seq, None, e, traced=self.traced))
        if isinstance(value, SourceRecordError):
            return seq, "error", None, json.dumps(payload(seq, None, value.error, value.metadata, self.traced))
        for s in stages:
            try:
                value = s.process(value, context)
            except Exception as e:
                return seq, "error", None, json.dumps(payload(seq, s.name, e, traced=self.traced))
            if value is DROP:
                return seq, "dropped", None, None
        try:
            return seq, "ok", self.encode(value), None
        except Exception as e:
            return seq, "sink", None, json.dumps(payload(seq, None, e))
