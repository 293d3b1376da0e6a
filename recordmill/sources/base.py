"""The protocols of sources and sinks, and positions of records in files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordmill.errors import SourceError
from recordmill.model import RuntimeContext
from recordmill.sharding import Sharding
from recordmill.sources import files

# Endings of JSONL files.
JSONL_ENDINGS = (".jsonl", ".jsonl.gz", ".jsonl.zst")


class Source:
    """A source gives a DataFrame of ``seq`` (global, from 0) and the columns that ``decode`` makes a record of.

    A source of one's own needs ``__iter__`` alone; it is then read through on the driver. With ``iter_shard`` it deals
    out its records to ranks itself.
    """

    #: Whether the columns are typed, so that native stages can run on them.
    typed = False

    def __iter__(self) -> Iterator[Any]:
        """All records, on the driver."""
        spark = SparkSession.builder.getOrCreate()
        df = self.frame(spark, RuntimeContext()).drop("_split").orderBy("seq")
        decode = self.decode([c for c in df.columns if c != "seq"])
        for row in df.toLocalIterator():
            yield decode(tuple(row[c] for c in df.columns if c != "seq"))

    def iter_shard(self, rank: int, world_size: int) -> Iterator[Any] | None:
        """This rank's records; None where a sharding deals them out."""
        return None

    def open(self, runtime: RuntimeContext) -> None:
        """Runs before a run reads."""

    def close(self) -> None:
        """Runs after a run, whether it ended well or not."""

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def frame(self, spark: SparkSession, runtime: RuntimeContext) -> DataFrame:
        from recordmill.sources.local import held

        if type(self).__iter__ is Source.__iter__:
            raise NotImplementedError("a source has __iter__ or frame")
        own = self.iter_shard(runtime.rank, runtime.world_size) if runtime.world_size > 1 else None
        return held(spark, self if own is None else own)

    def decode(self, columns: list[str]) -> Callable[[tuple], Any]:
        from recordmill.sources.local import unpickled

        return unpickled

    def physical(self, runtime: RuntimeContext) -> bool:
        """Whether ``frame`` already has only this rank's share."""
        return runtime.world_size > 1 and self.iter_shard(runtime.rank, runtime.world_size) is not None

    def total(self, spark: SparkSession) -> int | None:
        return None

    def owned(self, spark: SparkSession, runtime: RuntimeContext, sharding: Sharding) -> DataFrame:
        """This rank's records with a ``seq`` of their own from 0. No record is shuffled."""
        df = self.frame(spark, runtime)
        if runtime.world_size == 1 or self.physical(runtime):
            return df.drop("_split")
        rank, world = runtime.rank, runtime.world_size
        total = self.total(spark) if callable(self.total) else self.total
        mine, place = sharding.column(rank, world, total), sharding.position(rank, world, total)
        if mine is not None and place is not None:
            return df.filter(mine).withColumn("seq", place.cast("long")).drop("_split")
        if mine is not None:
            return renumbered(df.filter(mine))
        plain = [c for c in df.columns if c not in ("seq", "_split")]
        df = df.select("seq", *plain, *(["_split"] if "_split" in df.columns else []))
        decode, n = self.decode(plain), len(plain)

        def keep(batches):
            for b in batches:
                rows = zip(*(c.to_pylist() for c in b.columns[: n + 1]))
                yield b.filter(pa.array([sharding.owns(seq, decode(tuple(row)), rank, world) for seq, *row in rows], pa.bool_()))

        return renumbered(df.mapInArrow(keep, df.schema))


#: Splits whose offsets are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def _offset(rows: DataFrame, keys: list[str], order: Callable[[Any], Any], *more: Column) -> DataFrame:
    """Adds ``seq`` and ``_start`` to rows whose ``_id`` counts on within each group of ``keys``; the driver sees a row a group."""
    found = rows.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), *more).collect()
    offsets, at = [], 0
    for r in sorted(found, key=order):
        offsets.append((*(r[k] for k in keys), at - r["_first"], at))
        at += r["_n"]
    schema = StructType([rows.schema[k] for k in keys]).add("_off", "long").add("_start", "long")
    known = rows.sparkSession.createDataFrame(offsets, schema)
    joined = rows.join(F.broadcast(known) if len(offsets) <= BROADCAST else known, keys)
    return joined.withColumn("seq", F.col("_id") + F.col("_off")).drop(*keys, "_id", "_off")


def renumbered(df: DataFrame) -> DataFrame:
    """``seq`` from 0 without gaps, in the same order. What a task has of one split is in order, so a row for each gives the places."""
    columns = [c for c in df.columns if c != "_split"]
    rows = df.withColumns({"_p": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    if "_split" not in df.columns:
        rows = rows.withColumn("_split", F.lit(0).cast("long"))
    return _offset(rows, ["_p", "_split"], lambda r: r["_at"], F.min("seq").alias("_at")).select(columns)


def numbered(df: DataFrame, order: Callable[[str], Any]) -> DataFrame:
    """Adds ``seq``: the place of each row in its files, the files sorted by ``order`` of their paths, and ``_split``.

    Rows of one split of a file have consecutive ids right after the scan and its filters. The splits are sorted on the
    driver, which sees one row for each; their offsets are joined by broadcast, so that records stay where they are.
    """
    scan = df.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    return _offset(scan, ["_f", "_b"], lambda r: (order(r["_f"]), r["_b"])).withColumnRenamed("_start", "_split")


def numbered_by_index(df: DataFrame, order: Callable[[str], Any]) -> DataFrame:
    """The same for whole Parquet files, by the rows' own numbers in them: filters above reach the scan."""
    scan = df.withColumns({"_f": F.col("_metadata.file_path"), "_id": F.col("_metadata.row_index")})
    return _offset(scan, ["_f"], lambda r: order(r["_f"])).withColumnRenamed("_start", "_split")


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """The file, or a directory's files of these endings by name."""
    if files.is_dir(path):
        found = sorted((x for x in files.listed(path) if files.base(x).endswith(endings)), key=files.base)
    else:
        found = [path] if files.exists(path) else []
    if not found:
        raise SourceError(f"no files at {path}")
    return found


class Sink:
    """A sink says how workers encode results (``encode``), and writes the rows that a run gives it."""

    def encode(self) -> Callable[[Any], bytes]:
        raise NotImplementedError

    def open(self, runtime: RuntimeContext) -> None:
        pass

    def write_rows(self, rows: DataFrame, runtime: RuntimeContext, ordered: bool) -> None:
        """``rows(seq, value)``, values as ``encode`` made them."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def split_format(text: str) -> tuple[str, str]:
    """``[FORMAT:]PATH`` as format and path; by ending where no format is given, jsonl for directories and the rest."""
    head, colon, tail = text.partition(":")
    if colon and head in ("jsonl", "parquet"):
        return head, tail
    return ("parquet" if text.endswith(".parquet") and not files.is_dir(text) else "jsonl"), text
