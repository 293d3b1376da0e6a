"""Parquet: typed columns, pruned and filtered in the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate, pairwise
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from recordmill.errors import ParquetError, SinkError, SourceError
from recordmill.model import RuntimeContext
from recordmill.plans.program import pickled
from recordmill.sources import files as stored
from recordmill.sources.base import Sink, Source, numbered, numbered_by_index

OPS: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)),
}
#: Rows by which a sink without a schema infers one.
INFERRED = 4096


def condition(filters: Any) -> Column | None:
    """A Column, a (column, op, value), or a list of them, all to hold."""
    if filters is None or isinstance(filters, Column):
        return filters
    if isinstance(filters, tuple) and len(filters) == 3 and isinstance(filters[0], str):
        filters = [filters]
    if not isinstance(filters, (list, tuple)) or not filters:
        raise ParquetError(f"not filters: {filters!r}")
    parts = []
    for f in filters:
        if not isinstance(f, (tuple, list)) or len(f) != 3 or not isinstance(f[0], str) or not isinstance(f[1], str):
            raise ParquetError(f"not a filter of (column, op, value): {f!r}")
        op = OPS.get(f[1].lower() if f[1].lower() == "in" else f[1])
        if op is None:
            raise ParquetError(f"no such operator: {f[1]!r}")
        parts.append(op(F.col(f[0]), f[2]))
    return reduce(lambda a, b: a & b, parts)


class ParquetSource(Source):
    """A file, or a directory with its key=value folders as columns. Filters may use columns that aren't selected.

    On ranks of many, a directory's files, or a file's row groups, are dealt to the ranks in turn.
    """

    typed = True

    def __init__(self, path: str, *, columns: Sequence[str] | None = None, filters: Any = None, batch_size: int = 4096) -> None:
        self.path, self.columns, self.filters, self.batch_size = str(path), list(columns) if columns is not None else None, condition(filters), batch_size

    def files(self) -> list[str]:
        if stored.is_dir(self.path):
            found = sorted(x for x in stored.listed(self.path, deep=True) if x.endswith(".parquet") and not stored.base(x).startswith((".", "_")))
        else:
            found = [self.path] if stored.exists(self.path) else []
        if not found:
            raise SourceError(f"no Parquet files at {self.path}")
        return found

    def physical(self, runtime: RuntimeContext) -> bool:
        return runtime.world_size > 1

    def _scan(self, spark: SparkSession, runtime: RuntimeContext) -> DataFrame | None:
        if runtime.world_size == 1:
            return spark.read.parquet(self.path)
        files = self.files()
        reader = spark.read.option("basePath", self.path) if stored.is_dir(self.path) else spark.read
        if stored.is_dir(self.path):
            mine = files[runtime.rank :: runtime.world_size]
            return reader.parquet(*mine) if mine else reader.parquet(self.path).limit(0)
        meta = _footer(files[0])
        starts = [0, *accumulate(meta.row_group(k).num_rows for k in range(meta.num_row_groups))]
        # A row finds its group by the cell of ``step`` rows that it lies in: an expression of all groups has no bound.
        step = max(1, starts[-1] // max(1, meta.num_row_groups))
        own = [(c, a, b) for a, b in list(pairwise(starts))[runtime.rank :: runtime.world_size] for c in range(a // step, (b - 1) // step + 1)]
        cells = pa.table([pa.array(x, pa.int64()) for x in (zip(*own) if own else ([], [], []))], ["_cell", "_from", "_to"])
        index = F.col("_metadata.row_index")
        owns = (F.floor(index / step) == F.col("_cell")) & (index >= F.col("_from")) & (index < F.col("_to"))
        return reader.parquet(files[0]).join(F.broadcast(spark.createDataFrame(cells)), owns, "left_semi")  # three cells a group at most, about

    def native(self, spark: SparkSession, runtime: RuntimeContext | None = None) -> DataFrame:
        """Filter, then projection, as a plain DataFrame without ``seq``; both reach the scan."""
        df = self._scan(spark, runtime or RuntimeContext())
        df = df.filter(self.filters) if self.filters is not None else df
        return df.select(*self.columns) if self.columns is not None else df

    def frame(self, spark: SparkSession, runtime: RuntimeContext) -> DataFrame:
        """Filters come before numbers, so they reach the scan; without any, numbers are the files' own, and later filters do."""
        scan = self._scan(spark, runtime)
        names = self.columns if self.columns is not None else scan.columns
        whole = self.filters is None and (runtime.world_size == 1 or stored.is_dir(self.path))
        if self.filters is not None:
            scan = scan.filter(self.filters)
        if "seq" in names:
            scan = scan.withColumnRenamed("seq", "__seq")
        out = (numbered_by_index if whole else numbered)(scan, lambda p: p)
        return out.select("seq", *(f"`{'__seq' if n == 'seq' else n}`" for n in names), "_split")

    def decode(self, columns: list[str]) -> Callable[[tuple], Any]:
        return _Row(["seq" if c == "__seq" else c for c in columns])

    def total(self, spark: SparkSession | None = None, runtime: RuntimeContext | None = None) -> int | None:
        """Rows by the footers, this rank's share if there are many; unknown if filtered as well."""
        runtime = runtime or RuntimeContext()
        files = self.files()
        if runtime.world_size == 1:
            return sum(_footer(f).num_rows for f in files)
        if self.filters is not None:
            return None
        if stored.is_dir(self.path):
            return sum(_footer(f).num_rows for f in files[runtime.rank :: runtime.world_size])
        meta = _footer(files[0])
        return sum(meta.row_group(k).num_rows for k in range(runtime.rank, meta.num_row_groups, runtime.world_size))


def _footer(path: str) -> pq.FileMetaData:
    with stored.opened(path, "rb") as f:
        return pq.ParquetFile(f).metadata


class _Row:
    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __call__(self, row: tuple) -> dict[str, Any]:
        return dict(zip(self.names, row))


class ParquetSink(Sink):
    """Dict records as Parquet, with the given schema or that of the first records. Values that don't fit are an error.

    With ``batch_size``, a row group has so many rows at most. Without a schema and a record, a file has no columns.
    """

    def __init__(self, path: str, *, schema: pa.Schema | None = None, batch_size: int | None = None, compression: str = "zstd", **options: Any) -> None:
        self.path, self.schema, self.batch_size, self.compression, self.options = str(path), schema, batch_size, compression, options
        self.is_open = False

    def encode(self) -> Callable[[Any], bytes]:
        return pickled

    def open(self, runtime: RuntimeContext) -> None:
        self.is_open = True

    def close(self) -> None:
        self.is_open = False

    def target(self, runtime: RuntimeContext) -> str:
        if stored.is_dir(self.path) or self.path.endswith("/") or runtime.world_size == 1:
            return self.path
        stem, dot, ending = stored.base(self.path).rpartition(".")
        return stored.join(stored.parent(self.path), f"{stem}.part-{runtime.rank:05d}{dot}{ending}")

    def write_rows(self, rows: DataFrame, runtime: RuntimeContext, ordered: bool) -> None:
        import pickle

        if not self.is_open:
            raise SinkError("the sink isn't open")
        schema = self.schema
        if schema is None:
            first = [pickle.loads(r["value"]) for r in rows.orderBy("seq").limit(INFERRED).collect()]
            schema = pa.Table.from_pylist(first).schema if first else pa.schema([])
        target = self.target(runtime)
        if not len(schema):  # no record, so nothing to infer from
            if target.endswith(".parquet") and not stored.is_dir(target):
                with stored.opened(target, "wb") as f:
                    pq.write_table(schema.empty_table(), f)
            return
        rows = rows.repartitionByRange("seq").sortWithinPartitions("seq") if ordered else rows

        def run(batches):
            for b in batches:
                records = [pickle.loads(x) for x in b.column(1).to_pylist()]
                extra = {k for r in records for k in r} - set(schema.names)
                if extra:
                    raise ParquetError(f"columns that the schema doesn't have: {sorted(extra)}")
                yield pa.RecordBatch.from_pylist(records, schema=schema)

        typed = rows.select("seq", "value").mapInArrow(run, from_arrow_schema(schema))
        self.write_native(typed, runtime)

    def write_native(self, df: DataFrame, runtime: RuntimeContext) -> None:
        """A DataFrame of typed columns; no Python in between. A file's name gets one file, a directory as many as there are tasks."""
        target = self.target(runtime)
        options = {k: str(v) for k, v in self.options.items()} | ({"parquet.block.row.count.limit": str(self.batch_size)} if self.batch_size else {})
        if target.endswith(".parquet") and not stored.is_dir(target):
            folder = stored.join(stored.parent(target), f".{stored.base(target)}.parts")
            try:
                df.coalesce(1).write.mode("overwrite").option("compression", self.compression).options(**options).parquet(folder)
                (part,) = (x for x in stored.listed(folder) if x.endswith(".parquet"))
                stored.replace(part, target)
            finally:
                stored.delete(folder)
        else:
            df.write.mode("append").option("compression", self.compression).options(**options).parquet(target)
