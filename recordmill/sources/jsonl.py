"""JSON lines: each line is one record, and a bad line is one bad record."""

from __future__ import annotations

import io
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.errors import SinkError
from recordmill.model import RuntimeContext
from recordmill.plans.program import json_line, raw_line
from recordmill.sources import files as stored
from recordmill.sources.base import JSONL_ENDINGS, Sink, Source, listed, numbered

# Codecs by a file's ending.
CODECS = {".gz": "gzip", ".zst": "zstd", ".zstd": "zstd"}


def codec_of(path: str, given: str | None) -> str | None:
    """What a file is compressed with: the ending says it if ``auto``, nothing does if None or ``none``."""
    if given in (None, "none"):
        return None
    return CODECS.get(os.path.splitext(path)[1]) if given == "auto" else {"gz": "gzip", "zst": "zstd"}.get(given, given)


class JsonlSource(Source):
    """A file, or a directory's JSONL files by name. Blank lines are records too (they don't parse). ``raw`` gives the line."""

    def __init__(self, path: str, *, raw: bool = False, encoding: str = "utf-8", compression: str | None = "auto", loads: Callable[[str], Any] = json.loads) -> None:
        self.path, self.raw, self.encoding, self.compression, self.loads = str(path), raw, encoding, compression, loads

    def files(self) -> list[str]:
        return listed(self.path, JSONL_ENDINGS)

    def physical(self, runtime: RuntimeContext) -> bool:
        return runtime.world_size > 1 and stored.is_dir(self.path) and len(self.files()) > 1

    def frame(self, spark: SparkSession, runtime: RuntimeContext) -> DataFrame:
        files = self.files()
        if self.physical(runtime):
            files = files[runtime.rank :: runtime.world_size]
            if not files:
                return spark.createDataFrame([], "seq long, raw string")
        plain = self.encoding.lower().replace("_", "-") in ("utf-8", "utf8") and all(codec_of(f, self.compression) == codec_of(f, "auto") and not f.endswith(".zstd") for f in files)
        if plain:
            place = {stored.base(f): k for k, f in enumerate(files)}
            return numbered(spark.read.text(files), lambda p: place[stored.base(p)]).select("seq", F.col("value").alias("raw"), "_split")
        return self._decoded(spark, files)

    def _decoded(self, spark: SparkSession, files: list[str]) -> DataFrame:
        """Files whose codec or encoding Spark's reader doesn't take: a task for each, lines numbered by file."""
        encoding, codecs = self.encoding, [codec_of(f, self.compression) for f in files]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, path, codec in zip(*(c.to_pylist() for c in b.columns)):
                    with stored.opened(path, "rb") as f, (pa.CompressedInputStream(f, codec) if codec else f) as stream:
                        lines, n = [], 0
                        for line in io.TextIOWrapper(stream, encoding=encoding):
                            lines.append(line.removesuffix("\n"))
                            if len(lines) == 10_000:
                                yield batch(k, n, lines)
                                n, lines = n + len(lines), []
                        yield batch(k, n, lines)

        def batch(k: int, n: int, lines: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k] * len(lines), pa.int64()), pa.array(range(n, n + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["f", "n", "raw"])

        asked = spark.createDataFrame([(k, f, c) for k, (f, c) in enumerate(zip(files, codecs))], "f long, path string, codec string").repartition(len(files), "f")
        rows = asked.mapInArrow(run, "f long, n long, raw string")
        sizes, at, offsets = {r["f"]: r["c"] for r in rows.groupBy("f").agg(F.count("*").alias("c")).collect()}, 0, []
        for k in range(len(files)):
            offsets.append((k, at))
            at += sizes.get(k, 0)
        return rows.join(spark.createDataFrame(offsets, "f long, off long"), "f").select((F.col("off") + F.col("n")).alias("seq"), "raw")

    def decode(self, columns: list[str]) -> Callable[[tuple], Any]:
        if self.raw:
            return _first
        return _Loads(self.loads)


def _first(row: tuple) -> Any:
    return row[0]


class _Loads:
    def __init__(self, loads: Callable[[str], Any]) -> None:
        self.loads = loads

    def __call__(self, row: tuple) -> Any:
        return self.loads(row[0])


class _Dumps:
    def __init__(self, dumps: Callable[[Any], str]) -> None:
        self.dumps = dumps

    def __call__(self, x: Any) -> bytes:
        return self.dumps(x).encode()


class JsonlSink(Sink):
    """A file (``name.part-00001.jsonl`` on ranks of many), or a directory that gets ``part-NNNNN.jsonl`` files.

    Tasks write under names of their own; the driver gives files their names once all have ended well, so a
    task that runs twice leaves nothing behind.
    """

    def __init__(self, path: str, *, raw: bool = False, encoding: str = "utf-8", compression: str | None = "auto", flush_every: int = 0, dumps: Callable[[Any], str] | None = None) -> None:
        self.path, self.raw, self.encoding, self.compression, self.dumps, self.is_open = str(path), raw, encoding, compression, dumps, False

    def encode(self) -> Callable[[Any], bytes]:
        return raw_line if self.raw else _Dumps(self.dumps) if self.dumps else json_line

    def open(self, runtime: RuntimeContext) -> None:
        self.is_open = True

    def close(self) -> None:
        self.is_open = False

    def _is_dir(self) -> bool:
        return stored.is_dir(self.path) or self.path.endswith("/") or not re.search(r"\.\w+$", stored.base(self.path))

    def splits(self, runtime: RuntimeContext) -> bool:
        """Whether each task writes a file of its own."""
        return self._is_dir() and runtime.world_size == 1

    def target(self, part: int, runtime: RuntimeContext) -> str:
        if self._is_dir():
            ending = {"gzip": ".gz", "zstd": ".zst"}.get(codec_of("", self.compression) or "", "")
            return stored.join(self.path, f"part-{part:05d}.jsonl{ending}")
        if runtime.world_size == 1:
            return self.path
        stem, _, ending = stored.base(self.path).partition(".")
        return stored.join(stored.parent(self.path), f"{stem}.part-{runtime.rank:05d}.{ending}")

    def write_rows(self, rows: DataFrame, runtime: RuntimeContext, ordered: bool) -> None:
        if not self.is_open:
            raise SinkError("the sink isn't open")
        many = self.splits(runtime)
        if many:
            rows = rows.repartitionByRange("seq").sortWithinPartitions("seq") if ordered else rows
        else:
            rows = rows.coalesce(1).sortWithinPartitions("seq") if ordered else rows.coalesce(1)
        first = self.target(runtime.rank if self._is_dir() else 0, runtime)
        hidden, encoding, codec = stored.join(stored.parent(first), f".{uuid.uuid4().hex}"), self.encoding, codec_of(first, self.compression)
        stored.make_dir(hidden)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            path, n, out, plain = stored.join(hidden, uuid.uuid4().hex), 0, None, None
            for b in batches:
                if out is None:
                    plain = stored.opened(path, "wb")
                    out = pa.CompressedOutputStream(plain, codec) if codec else plain
                lines = b.column(1).to_pylist()
                data = b"".join(x + b"\n" for x in lines)
                out.write(data if encoding == "utf-8" else data.decode().encode(encoding))
                n += len(lines)
            if out is not None:
                out.close()
                plain.close()
                yield pa.RecordBatch.from_arrays([pa.array([task.partitionId() if task else 0], pa.int64()), pa.array([path]), pa.array([n], pa.int64())], ["part", "path", "n"])

        try:
            done = sorted((r["part"], r["path"]) for r in rows.select("seq", "value").mapInArrow(run, "part long, path string, n long").collect())  # a row a file
            if not done:
                done = [(0, stored.join(hidden, "none"))]
                stored.opened(done[0][1], "wb").close()
            for k, (_, path) in enumerate(done):
                stored.replace(path, self.target(k, runtime) if many else first)
        finally:
            stored.delete(hidden)
