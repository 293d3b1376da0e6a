"""Record programs over Structured Streaming: the same fused program, without state, on a stream of lines."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.operators.stages import Stage
from recordmill.plans.program import STATUS, RecordProgram, json_line
from recordmill.plans.run import Pipeline
from recordmill.sources.jsonl import JsonlSource


def stream_results(spark: SparkSession, path: str, pipeline: Pipeline | list[Stage], *, raw: bool = False, encode: Callable[[Any], bytes] = json_line, **options: str) -> DataFrame:
    """A streaming DataFrame of STATUS rows for the files that come to a directory.

    Streams have no global order, so ``seq`` is null; a record's place is its file's business. A checkpoint of
    the query that writes these rows gives each line exactly one result.
    """
    pipeline = pipeline if isinstance(pipeline, Pipeline) else Pipeline(pipeline)
    lines = spark.readStream.options(**options).text(path).select(F.lit(None).cast("long").alias("seq"), F.col("value").alias("raw"))
    return lines.mapInArrow(RecordProgram(pipeline.stages, JsonlSource(path, raw=raw).decode(["raw"]), encode), STATUS)


def write_lines(results: DataFrame, out: str, checkpoint: str, *, errors: str | None = None) -> Any:
    """Starts a query that writes good results to ``out`` as lines, and payloads of errors to ``errors``.

    Each batch has a folder of its own, ``batch=N``, that a repeated batch writes anew: no line comes twice. The program
    runs once a batch, whether errors are written or not.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            rows.where("status = 'ok'").select(F.col("value").cast("string")).write.mode("overwrite").text(f"{out}/batch={number}")
            if errors:
                rows.where("status = 'error'").select("error").write.mode("overwrite").text(f"{errors}/batch={number}")
        finally:
            rows.unpersist()

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
