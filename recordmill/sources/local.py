"""Python objects as sources and sinks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.model import RuntimeContext, SourceRecordError
from recordmill.plans.program import pickled
from recordmill.sources.base import Sink, Source
from recordmill.sources.files import scratch

#: Records, and bytes of them, that the driver holds; beyond them they go to the scratch folder as they come.
HELD, HELD_BYTES = 100_000, 64 << 20
#: Records, and bytes of them, that a sink on the driver fetches at once, about.
FETCHED, FETCHED_BYTES = 100_000, 8 << 20
_SCHEMA = pa.schema([("seq", pa.int64()), ("value", pa.binary())])


def _counted(items: Iterable[Any]) -> Iterator[tuple[int, bytes]]:
    it, seq = iter(items), 0
    while True:
        try:
            x = next(it)
        except StopIteration:
            return
        except SourceRecordError as bad:  # the source says so itself, and ends
            yield seq, pickled(SourceRecordError(bad.error, bad.metadata))
            return
        yield seq, pickled(x)
        seq += 1


def held(spark: SparkSession, items: Iterable[Any]) -> DataFrame:
    """``seq`` and ``value`` (pickled) of what an iterable gives, read through once, on the driver.

    A SourceRecordError that it gives is a bad record; one that it raises is its last. Many records are written as they
    come, so that the driver holds ``HELD`` of them at most.
    """
    seqs, values, size, path = [], [], 0, None

    def frame() -> DataFrame:
        return spark.createDataFrame(pa.table([seqs, values], schema=_SCHEMA))

    for seq, value in _counted(items):
        seqs.append(seq)
        values.append(value)
        size += len(value)
        if len(seqs) == HELD or size >= HELD_BYTES:
            path = path or scratch(spark)
            frame().write.mode("append").parquet(path)
            seqs, values, size = [], [], 0
    if path is None:
        return frame()
    if seqs:
        frame().write.mode("append").parquet(path)
    return spark.read.schema("seq long, value binary").parquet(path).withColumn("_split", F.xxhash64("_metadata.file_path"))


def unpickled(row: tuple) -> Any:
    return pickle.loads(row[0])


class IterableSource(Source):
    """Any iterable. It is read through once, on the driver; SourceRecordError items are bad records."""

    def __init__(self, iterable: Iterable[Any]) -> None:
        self.iterable = iterable

    def __iter__(self) -> Iterator[Any]:
        return iter(self.iterable)

    def total(self, spark: SparkSession | None = None) -> int | None:
        return len(self.iterable) if isinstance(self.iterable, (list, tuple, range, set, frozenset)) else None


class CallableSink(Sink):
    """Calls a function with each record, on the driver, which fetches ``FETCHED`` of them at a time, about."""

    def __init__(self, fn: Callable[[Any], None]) -> None:
        self.fn = fn

    def encode(self) -> Callable[[Any], bytes]:
        return pickled

    def write_rows(self, rows: DataFrame, runtime: RuntimeContext, ordered: bool) -> None:
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("bytes")).first()
        parts = max(-(-size["n"] // FETCHED), -(-size["bytes"] // FETCHED_BYTES))
        if parts > 1:
            rows = rows.repartitionByRange(parts, "seq")
        if ordered:
            rows = rows.sortWithinPartitions("seq") if parts > 1 else rows.orderBy("seq")
        for r in rows.select("value").toLocalIterator():
            self.fn(pickle.loads(r["value"]))


class ListSink(CallableSink):
    def __init__(self) -> None:
        self.records: list[Any] = []
        super().__init__(self.records.append)
