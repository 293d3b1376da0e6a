"""Errors of pipelines, sources and sinks."""

from __future__ import annotations


class RecordmillError(Exception):
    """Base of all errors of this package's pipelines."""


class PipelineValidationError(RecordmillError):
    """A pipeline or an option of a run is not valid."""


class ShardingError(RecordmillError):
    """A sharding can't be used, or not on this source."""


class SourceError(RecordmillError):
    """A source can't be opened or read."""


class SinkError(RecordmillError):
    """A sink can't take a record or is used out of turn."""


class ParquetError(RecordmillError):
    """Parquet filters, columns or schemas that don't fit."""


class RuntimeDetectionError(RecordmillError):
    """Rank and world size don't fit together."""


class WorkerSetupError(RecordmillError):
    """A stage's setup failed; no policy skips it."""


class StageExecutionError(RecordmillError):
    """A stage failed on one record; ``cause`` has the type, message and traceback from the worker."""

    def __init__(self, stage_name: str | None, record_seq: int | None, cause: object = None) -> None:
        super().__init__(f"stage {stage_name!r} failed on record {record_seq}: {cause}")
        self.stage_name, self.record_seq, self.cause = stage_name, record_seq, cause

    def __reduce__(self):
        return type(self), (self.stage_name, self.record_seq, self.cause)


class RemoteError(RecordmillError):
    """What a worker raised, by name and text, as its class may not be known here."""

    def __init__(self, error_type: str, message: str, trace: str = "") -> None:
        super().__init__(f"{error_type}: {message}")
        self.error_type, self.message, self.trace = error_type, message, trace

    def __reduce__(self):
        return type(self), (self.error_type, self.message, self.trace)
