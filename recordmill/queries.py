"""A query for each operator of the engine over the standard tables, and its DuckDB SQL."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import cli, model
from recordmill.dsl.compiler import compile_expression
from recordmill.dsl.errors import ExpressionError
from recordmill.errors import RecordmillError, StageExecutionError
from recordmill.functions.builtins import BUILTINS
from recordmill.functions.types import JsonType, OneOf
from recordmill.model import DROP, RuntimeContext, SourceRecordError
from recordmill.operators.stages import FilterStage, GenericStage, JsonDumpStage, JsonLoadStage, TapStage, ToolProgramStage, TransformStage
from recordmill.plans.program import json_line
from recordmill.plans.run import Pipeline, report
from recordmill.sharding import HashSharding, ModuloSharding, NoSharding, RangeSharding
from recordmill.sources import files
from recordmill.sources.base import Source, split_format
from recordmill.sources.files import scratch
from recordmill.sources.jsonl import JsonlSink, JsonlSource
from recordmill.sources.local import CallableSink, IterableSource, ListSink
from recordmill.sources.parquet import ParquetSink, ParquetSource
from recordmill.tools.contract import ToolDefinitionError, annotation_from_json, annotation_to_json, contract_of, make_contract, tool
from recordmill.tools.provider import Descriptor, ProviderError
from recordmill.tools.registry import Registry, Resolved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(sf: str, name: str, **options: Any) -> ParquetSource:
    return ParquetSource(f"{sf}/{name}.parquet", **options)


def typed(rows: DataFrame, schema: str, status: str = "ok") -> DataFrame:
    """JSON values of STATUS rows as columns."""
    value = F.col("value").cast("string") if status == "ok" else F.col("error")
    return rows.where(F.col("status") == status).select(F.from_json(value, schema).alias("x")).select("x.*")


def run(spark: SparkSession, source: Any, stages: list, schema: str, **options: Any) -> DataFrame:
    return typed(Pipeline(stages).results(spark, source, **options), schema)


def _names(more: dict) -> dict:
    return {n: Resolved("builtin", contract_of(f), function=f) for n, f in BUILTINS.items()} | more


def program(expression: str, names: dict | None = None, validate: str = "always") -> ToolProgramStage:
    return ToolProgramStage(compile_expression(expression, _names(names or {})), validate=validate)


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and all tasks reach; a plain path where it is one."""
    path = scratch(spark)
    files.make_dir(path)
    return files.local(path) or path


def cases(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """What the driver found out, as a table."""
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same table in SQL."""

    def literal(x: Any) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


# -- Parquet -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(sf, "orders", columns=["o_orderkey", "o_totalprice"]).native(spark)


def _filtered(key: str, op: str, value: Any, sql: str) -> None:
    @query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {sql}", f"parquet_filter_{key}")
    def filtered(spark: SparkSession, sf: str) -> DataFrame:
        return table(sf, "lineitem", columns=["l_orderkey", "l_linenumber", "l_quantity"], filters=("l_quantity", op, value)).native(spark)


for _key, _op, _value, _sql in (
    ("eq", "==", 10.0, "l_quantity = 10"), ("ne", "!=", 10.0, "l_quantity <> 10"), ("lt", "<", 10.0, "l_quantity < 10"), ("le", "<=", 10.0, "l_quantity <= 10"),
    ("gt", ">", 40.0, "l_quantity > 40"), ("ge", ">=", 40.0, "l_quantity >= 40"), ("in", "IN", [1.0, 7.0], "l_quantity IN (1, 7)"),
):
    _filtered(_key, _op, _value, _sql)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def parquet_filter_and(spark: SparkSession, sf: str) -> DataFrame:
    return table(sf, "lineitem", columns=["l_orderkey", "l_linenumber"], filters=[("l_quantity", ">", 45.0), ("l_returnflag", "==", "R")]).native(spark)


@query("SELECT c_name FROM customer WHERE c_acctbal < 0")
def parquet_filter_unprojected(spark: SparkSession, sf: str) -> DataFrame:
    return table(sf, "customer", columns=["c_name"], filters=("c_acctbal", "<", 0.0)).native(spark)


@query("SELECT event_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def hive_partition_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/events"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("event_id", "event_type").write.partitionBy("event_type").parquet(out)
    least = events.agg(F.min("event_type")).first()[0]
    return ParquetSource(out, columns=["event_id", "event_type"], filters=("event_type", "==", least)).native(spark)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/part"
    schema = pa.schema([("p_partkey", pa.int64()), ("p_name", pa.string()), ("p_size", pa.int32()), ("p_retailprice", pa.float64())])
    source = table(sf, "part", columns=schema.names)
    Pipeline([lambda r: r]).run(source, ParquetSink(f"{out}/", schema=schema), spark=spark, runtime=RuntimeContext())
    return spark.read.parquet(out)


# -- JSONL -------------------------------------------------------------------------------------------------------

NATION = "n_nationkey int, n_name string, n_regionkey int"


def _through_jsonl(name: str, ending: str, raw: bool = False, **options: Any) -> None:
    @query("SELECT n_nationkey, n_name, n_regionkey FROM nation", name)
    def through(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{folder(spark)}/nation{ending}"
        Pipeline([lambda r: r]).run(table(sf, "nation"), JsonlSink(path), spark=spark, runtime=RuntimeContext())
        stages = [JsonLoadStage()] if raw else [TransformStage(dict)]
        return run(spark, JsonlSource(path, raw=raw, **options), stages, NATION)


_through_jsonl("jsonl_parsed", ".jsonl")
_through_jsonl("jsonl_raw", ".jsonl", raw=True)
_through_jsonl("jsonl_gzip", ".jsonl.gz")
_through_jsonl("jsonl_zstd", ".jsonl.zst")


def _with_bad_lines(spark: SparkSession, sf: str) -> JsonlSource:
    """Orders' keys as lines in order, each tenth one broken."""
    out = f"{folder(spark)}/orders.jsonl"
    Pipeline([lambda r: "NOT JSON" if r["o_orderkey"] % 10 == 0 else json.dumps({"k": r["o_orderkey"]})]).run(
        table(sf, "orders", columns=["o_orderkey"]), JsonlSink(out, raw=True), spark=spark, runtime=RuntimeContext()
    )
    return JsonlSource(out)


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0")
def jsonl_malformed_skip(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/good.jsonl"
    Pipeline([TransformStage(dict)]).run(_with_bad_lines(spark, sf), JsonlSink(out), errors="skip", spark=spark, runtime=RuntimeContext())
    return spark.read.schema("k long").json(out)


@query("SELECT CAST(rn - 1 AS BIGINT) AS seq, 'JSONDecodeError' AS error_type FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE o_orderkey % 10 = 0")
def jsonl_malformed_return(spark: SparkSession, sf: str) -> DataFrame:
    out = folder(spark)
    Pipeline([TransformStage(dict)]).run(
        _with_bad_lines(spark, sf), JsonlSink(f"{out}/good.jsonl"), errors="return", error_sink=JsonlSink(f"{out}/bad.jsonl"), spark=spark, runtime=RuntimeContext()
    )
    return spark.read.schema("seq long, error_type string").json(f"{out}/bad.jsonl")


@query("SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders")
def ordered_seq(spark: SparkSession, sf: str) -> DataFrame:
    out = folder(spark)
    keys = table(sf, "orders", columns=["o_orderkey"])
    Pipeline([lambda r: {"k": r["o_orderkey"]}]).run(keys, JsonlSink(f"{out}/lines/"), spark=spark, runtime=RuntimeContext())
    rows = Pipeline([TransformStage(lambda r: r["k"])]).results(spark, JsonlSource(f"{out}/lines"))
    return rows.select(F.col("value").cast("string").cast("long").alias("k"), "seq")


# -- Stages ------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier")
def stage_transform(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "supplier"), [lambda r: {"s_suppkey": r["s_suppkey"], "doubled": r["s_acctbal"] * 2}], "s_suppkey long, doubled double")


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier WHERE s_acctbal > 0")
def stage_native(spark: SparkSession, sf: str) -> DataFrame:
    source = table(sf, "supplier", columns=["s_suppkey", "s_acctbal"])
    stages = [FilterStage(F.col("s_acctbal") > 0), TransformStage({"doubled": F.col("s_acctbal") * 2}), lambda r: {"s_suppkey": r["s_suppkey"], "doubled": r["doubled"]}]
    return run(spark, source, stages, "s_suppkey long, doubled double")


@query("SELECT p_partkey, p_name FROM part WHERE p_size < 10")
def stage_filter(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "part"), [FilterStage(lambda r: r["p_size"] < 10), lambda r: {k: r[k] for k in ("p_partkey", "p_name")}], "p_partkey long, p_name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stage_tap(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "nation"), [TapStage(lambda r: None)], NATION)


@query("SELECT n_nationkey, lower(n_name) || '!' AS n_name FROM nation WHERE n_regionkey <> 1")
def stage_generic(spark: SparkSession, sf: str) -> DataFrame:
    stage = GenericStage(
        input=lambda r: r if r["n_regionkey"] != 1 else DROP,
        process=lambda r: {"n_nationkey": r["n_nationkey"], "n_name": r["n_name"].lower()},
        output=lambda r: r | {"n_name": r["n_name"] + "!"},
    )
    return run(spark, table(sf, "nation"), [stage], "n_nationkey int, n_name string")


@query("SELECT count(*) AS input_records, count(*) FILTER (o_orderstatus = 'F') AS output_records, count(*) FILTER (o_orderstatus <> 'F') AS dropped_records FROM orders")
def stage_drop_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = Pipeline([FilterStage(lambda r: r["o_orderstatus"] == "F")]).run(
        table(sf, "orders", columns=["o_orderkey", "o_orderstatus"]), JsonlSink(f"{folder(spark)}/out.jsonl"), errors="skip", spark=spark, runtime=RuntimeContext()
    )
    return spark.createDataFrame([(stats.input_records, stats.output_records, stats.dropped_records)], "input_records long, output_records long, dropped_records long")


EVENTS = ["event_id", "props"]


def _prop_lines(spark: SparkSession, sf: str) -> JsonlSource:
    """The props of events, a JSON text a line."""
    out = f"{folder(spark)}/props.jsonl"
    Pipeline([lambda r: r["props"]]).run(table(sf, "events", columns=EVENTS), JsonlSink(out, raw=True), spark=spark, runtime=RuntimeContext())
    return JsonlSource(out, raw=True)


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_load(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, _prop_lines(spark, sf), [JsonLoadStage()], "k long")


@query("SELECT props FROM events")
def json_dump(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/again.jsonl"
    Pipeline([JsonLoadStage(), JsonDumpStage()]).run(_prop_lines(spark, sf), JsonlSink(out, raw=True), spark=spark, runtime=RuntimeContext())
    return spark.read.text(out).withColumnRenamed("value", "props")


# -- Expressions -------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fromjson_field(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "events", columns=EVENTS), [program("fromjson(.props)")], "event_id long, props struct<k: long>").select("event_id", F.col("props.k").alias("k"))


@query("SELECT event_id, replace(props, ' ', '') AS props FROM events")
def fromjson_chain_tojson(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "events", columns=EVENTS), [program("fromjson(.props) | tojson(.props)")], "event_id long, props string")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '7' AS n FROM events")
def fromjson_recursive(spark: SparkSession, sf: str) -> DataFrame:
    nest = TransformStage(lambda r: {"event_id": r["event_id"], "x": json.dumps({"deep": r["props"], "n": "7"})}, "nest")
    out = run(spark, table(sf, "events", columns=EVENTS), [nest, program("fromjson(.x, recursive=true)")], "event_id long, x struct<deep: struct<k: long>, n: string>")
    return out.select("event_id", F.col("x.deep.k").alias("k"), F.col("x.n").alias("n"))


@query("SELECT event_id, CAST(7 AS BIGINT) AS n FROM events")
def fromjson_scalars(spark: SparkSession, sf: str) -> DataFrame:
    nest = TransformStage(lambda r: {"event_id": r["event_id"], "x": json.dumps({"n": "7"})}, "nest")
    out = run(spark, table(sf, "events", columns=EVENTS), [nest, program("fromjson(.x, recursive=true, containers_only=false)")], "event_id long, x struct<n: long>")
    return out.select("event_id", F.col("x.n").alias("n"))


def _tojson(name: str, arguments: str, sql: str) -> None:
    @query(f"SELECT r_regionkey, {sql} AS x FROM region", f"tojson_{name}")
    def encoded(spark: SparkSession, sf: str) -> DataFrame:
        stages = [lambda r: {"r_regionkey": r["r_regionkey"], "x": {"name": "é" + r["r_name"], "key": r["r_regionkey"]}}, program(f"tojson(.x{arguments})")]
        return run(spark, table(sf, "region"), stages, "r_regionkey int, x string")


_tojson("compact", "", """'{"name":"é' || r_name || '","key":' || r_regionkey || '}'""")
_tojson("spaced", ", compact=false", """'{"name": "é' || r_name || '", "key": ' || r_regionkey || '}'""")
_tojson("sorted", ", sort_keys=true", """'{"key":' || r_regionkey || ',"name":"é' || r_name || '"}'""")
_tojson("ascii", ", ensure_ascii=true", """'{"name":"\\u00e9' || r_name || '","key":' || r_regionkey || '}'""")


@query("SELECT '[' || c_custkey || ',' || c_nationkey || ']' AS x FROM customer")
def selector_root(spark: SparkSession, sf: str) -> DataFrame:
    rows = Pipeline([lambda r: [r["c_custkey"], r["c_nationkey"]], program("tojson(.)"), lambda x: {"x": x}]).results(spark, table(sf, "customer"))
    return typed(rows, "x string")


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS second FROM customer")
def selector_index(spark: SparkSession, sf: str) -> DataFrame:
    stages = [lambda r: {"c_custkey": r["c_custkey"], "a": [r["c_name"], r["c_nationkey"]]}, program("tojson(.a[1])"), lambda r: {"c_custkey": r["c_custkey"], "second": r["a"][1]}]
    return run(spark, table(sf, "customer"), stages, "c_custkey long, second string")


@query("SELECT c_custkey, '\"' || c_mktsegment || '\"' AS seg FROM customer")
def selector_quoted(spark: SparkSession, sf: str) -> DataFrame:
    stages = [lambda r: {"c_custkey": r["c_custkey"], "a.b": r["c_mktsegment"]}, program('tojson(.["a.b"])'), lambda r: {"c_custkey": r["c_custkey"], "seg": r["a.b"]}]
    return run(spark, table(sf, "customer"), stages, "c_custkey long, seg string")


@query("SELECT c_custkey, '1-' || c_nationkey AS joined FROM customer")
def selector_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    stages = [
        lambda r: {"c_custkey": r["c_custkey"], "a": [{"b": 1}, {"b": r["c_nationkey"]}]},
        program("tojson(.a[].b)"),
        lambda r: {"c_custkey": r["c_custkey"], "joined": "-".join(x["b"] for x in r["a"])},
    ]
    return run(spark, table(sf, "customer"), stages, "c_custkey long, joined string")


@query("SELECT c_custkey, CAST(0 AS INT) AS n FROM customer")
def selector_empty_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    stages = [lambda r: {"c_custkey": r["c_custkey"], "a": []}, program("tojson(.a[].b)"), lambda r: {"c_custkey": r["c_custkey"], "n": len(r["a"])}]
    return run(spark, table(sf, "customer"), stages, "c_custkey long, n int")


INSPECTED = [(0, "fromjson", ".tools", "string|array|object", "any"), (1, "tojson", ".tools[].name", "any", "string")]


@query(values(INSPECTED, "position, tool, selector, input, output"))
def inspect_expression(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(d["index"], d["tool"], d["selector"], d["input"], d["output"]) for d in program("fromjson(.tools) | tojson(.tools[].name)").compiled.describe()]
    return spark.createDataFrame(rows, "position int, tool string, selector string, input string, output string")


# Expressions with what becomes of them: an error's class, or the compiled call.
COMPILED = [
    ("fromjson(.a", "ExpressionSyntaxError"), ("fromjson(a)", "ExpressionSyntaxError"), ("fromjson(.a) |", "ExpressionSyntaxError"), ("fromjson(.a[1.5])", "ExpressionSyntaxError"),
    ("fromjson(.a, recursive='open)", "ExpressionSyntaxError"), ("nope(.a)", "ToolResolutionError"), ("other.shout(.a)", "ToolResolutionError"), ("fromjson(.a, deep=true)", "ToolConfigurationError"),
    ("fromjson(.a, recursive=1)", "ToolConfigurationError"), ("tojson(.a, compact=true, compact=false)", "ToolConfigurationError"), ("add_metadata(.a, source='x')", "ToolConfigurationError"),
    ("add_metadata(.)", "ToolConfigurationError"), ("numbers(.a) | shout(.a)", "ToolConfigurationError"), ("numbers(.a[]) | shout(.a[])", "numbers,shout"), ("numbers(.a) | shout(.b)", "numbers,shout"),
    ("shout(.a, suffix='?')", "shout"), ("my.shout(.a)", "my.shout"), ("fromjson(.é_1)", "fromjson"), ("tojson(.) | tojson(.)", "tojson,tojson"),
]


@query(values(COMPILED, "expression, outcome"))
def expression_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Syntax, resolution, binding, scope and compatibility of neighbours, all settled before data is read."""

    def outcome(text: str) -> str:
        try:
            return ",".join(i.name for i in compile_expression(text, _names(TOOLS)).invocations)
        except ExpressionError as e:
            return type(e).__name__

    return cases(spark, [(x, outcome(x)) for x, _ in COMPILED], "expression string, outcome string")


LITERALS = [
    ("'a\\nb'", '"a\\nb"'), ('"q\\"q"', '"q\\"q"'), ("'\\u0041'", '"u0041"'), ("-12", "-12"), ("1.5e3", "1500.0"), ("true", "true"), ("None", "null"), ("[1, [2, 'x'], {}]", '[1, [2, "x"], {}]'),
    ("{'k': false, \"a b\": [null]}", '{"k": false, "a b": [null]}'),
]


@query(values(LITERALS, "literal, value"))
def expression_literals(spark: SparkSession, sf: str) -> DataFrame:
    got = [compile_expression(f"anything(., x={x})", _names(TOOLS)).invocations[0].arguments["x"] for x, _ in LITERALS]
    return cases(spark, [(x, json.dumps(v)) for (x, _), v in zip(LITERALS, got)], "literal string, value string")


RENDERED = [(".", "."), (".a", ".a"), (".a.b", ".a.b"), ('.["a b"]', '.["a b"]'), (".a[0][]", ".a[0][]"), ('.a[]["k"].c', ".a[].k.c"), (".[3]", ".[3]"), (".a[-1]", ".a[-1]")]


@query(values(RENDERED, "given, path"))
def selector_rendered(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, [(x, compile_expression(f"anything({x}, x=1)", _names(TOOLS)).invocations[0].path) for x, _ in RENDERED], "given string, path string")


MARKED = [("fromjson(.a, deep=1)", "  fromjson(.a, deep=1)", "               ^^^^^^"), ("nope(.a)", "  nope(.a)", "  ^^^^^^^^")]


@query(values(MARKED, "expression, line, carets"))
def expression_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for text, _, _ in MARKED:
        try:
            compile_expression(text, _names({}))
        except ExpressionError as e:
            rows.append((text, *str(e).split("\n")[1:]))
    return cases(spark, rows, "expression string, line string, carets string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'selector' WHEN n_nationkey % 3 = 1 THEN 'input' ELSE 'call' END AS stage FROM nation")
def tool_failure_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Where a call fails: no such key, a value of another type, text that isn't JSON."""
    make = TransformStage(lambda r: {"k": r["n_nationkey"]} | [{}, {"v": 1}, {"v": "NOT JSON"}][r["n_nationkey"] % 3], "make")
    rows = Pipeline([make, program("fromjson(.v)")]).results(spark, table(sf, "nation"))
    found = typed(rows, "seq long, tool struct<stage: string>", "error")
    return found.select(F.col("seq").cast("int").alias("n_nationkey"), F.col("tool.stage").alias("stage"))


@query("SELECT seq FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders) WHERE seq >= 100")
def validate_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts are checked on a partition's first 100 records only: one partition here."""
    source = table(sf, "orders", columns=["o_orderkey"])
    rows, _ = Pipeline([program("number_out(.o_orderkey)", TOOLS, "sample")]).plan(spark, source, json_line, RuntimeContext(), NoSharding(), 1)
    return rows.where("status = 'ok'").select("seq")


# -- Tools -------------------------------------------------------------------------------------------------------


@tool("shout", input=JsonType.STRING, output=JsonType.STRING)
def shout(value: str, *, suffix: str = "!") -> str:
    return value.upper() + suffix


@tool("add_metadata", target="record", input=JsonType.OBJECT, output=JsonType.OBJECT)
def add_metadata(record: dict, *, source: str) -> dict:
    return record | {"source": source}


@tool("stringify", input=OneOf(JsonType.STRING, JsonType.INTEGER), output=JsonType.STRING)
def stringify(value: Any, *, prefix: str = "") -> str:
    return f"{prefix}{value}"


@tool("number_out", input=JsonType.ANY, output=JsonType.STRING)
def number_out(value: Any) -> Any:
    return len(str(value))


@tool("numbers", input=JsonType.ANY, output=JsonType.INTEGER)
def numbers(value: Any) -> int:
    return len(str(value))


@tool("anything", input=JsonType.ANY, output=JsonType.ANY)
def anything(value: Any, *, x: Any) -> Any:
    return x


TOOLS = {"my." + f.__tool_contract__.name: Resolved("my", contract_of(f), function=f) for f in (shout, add_metadata, stringify, number_out, numbers, anything)}
TOOLS |= {f.__tool_contract__.name: TOOLS["my." + f.__tool_contract__.name] for f in (shout, add_metadata, stringify, number_out, numbers, anything)}

PROVIDER = b"""
from recordmill import Example, JsonType, tool

@tool("louder", input=JsonType.STRING, output=JsonType.STRING, examples=[Example("a", "A!")])
def louder(value: str, *, suffix: str = "!") -> str:
    return value.upper() + suffix
"""


@query("SELECT p_partkey, upper(p_name) || '!' AS p_name FROM part")
def tool_provider(spark: SparkSession, sf: str) -> DataFrame:
    """A provider's tool: only its descriptor crosses to workers, which load the pinned bytes themselves."""
    space: dict[str, Any] = {"__name__": "provider"}
    exec(compile(PROVIDER, "<provider>", "exec"), space)  # noqa: S102  the contract; workers run the bytes
    pinned = Descriptor("loud", "louder", hashlib.sha256(PROVIDER).hexdigest(), PROVIDER)
    names = {"louder": Resolved("loud", contract_of(space["louder"]), pinned=pinned)}
    return run(spark, table(sf, "part", columns=["p_partkey", "p_name"]), [program("louder(.p_name)", names)], "p_partkey long, p_name string")


REGISTERED = [
    ("install", "louder"), ("install again", "ProviderError"), ("same alias", "ProviderError"), ("second provider", "louder"), ("louder", "ToolResolutionError"), ("mine.louder", "mine.louder"),
    ("file is gone, not named", "fromjson"), ("file is gone, named", "ProviderError"), ("changed bytes", "ProviderError"), ("not confirmed", "ProviderError"), ("remove", "mine"), ("remove again", "ProviderError"),
    ("broken registry", "0"), ("not Python", "ProviderError"), ("no tool", "ProviderError"), ("wrong example", "ProviderError"), ("fails to import", "ProviderError"), ("declared but missing", "ProviderError"),
]


@query(values(REGISTERED, "step, outcome"))
def registry_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Install, resolve, pin, remove and refuse providers, on the driver alone."""
    import tempfile
    import warnings
    from pathlib import Path

    from recordmill.tools.provider import load

    with tempfile.TemporaryDirectory() as top:  # a registry is the driver's own
        home, mine = Registry(f"{top}/home"), Path(top, "mine.py")
        mine.write_bytes(PROVIDER)
        rows = []

        def step(name: str, f: Callable[[], Any]) -> None:
            try:
                rows.append((name, str(f())))
            except (ExpressionError, ProviderError) as e:
                rows.append((name, type(e).__name__))

        def installed(text: bytes = PROVIDER, **options: Any) -> str:
            path = Path(top, "given.py")
            path.write_bytes(text)
            return ",".join(t.name for t in home.install(path, **options).tools)

        def compiled(text: str) -> str:
            return compile_expression(text, home).invocations[0].name

        step("install", lambda: installed(provider_id="mine"))
        step("install again", lambda: installed(provider_id="mine"))
        step("same alias", lambda: installed(provider_id="other", alias="mine"))
        step("second provider", lambda: installed(provider_id="second"))
        step("louder", lambda: compiled("louder(.a)"))
        step("mine.louder", lambda: compiled("mine.louder(.a)"))
        second = Path(next(p.path for p in home.providers() if p.provider_id == "second"))
        second.unlink()
        step("file is gone, not named", lambda: compiled("fromjson(.a)"))
        step("file is gone, named", lambda: compiled("second.louder(.a)"))
        second.write_bytes(PROVIDER + b"# changed")
        step("changed bytes", lambda: load(home.names()["second.louder"].descriptor))
        step("not confirmed", lambda: installed(provider_id="third", confirm=lambda _: False))
        home.remove("second")
        step("remove", lambda: ",".join(p.provider_id for p in home.providers()))
        step("remove again", lambda: home.remove("second"))
        home.file.write_text("not JSON")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            step("broken registry", lambda: len(home.providers()))
        step("not Python", lambda: installed(b"x = "))
        step("no tool", lambda: installed(b"x = 1"))
        step("wrong example", lambda: installed(PROVIDER.replace(b'"A!"', b'"B!"')))
        step("fails to import", lambda: installed(PROVIDER + b"raise ValueError('no')"))
        step("declared but missing", lambda: installed(PROVIDER + b"del louder"))
    return cases(spark, rows, "step string, outcome string")


DEFINED = [
    ("fine", "ok"), ("no parameter", "ToolDefinitionError"), ("default of the value", "ToolDefinitionError"), ("positional option", "ToolDefinitionError"), ("default without JSON", "ToolDefinitionError"),
    ("annotation conflict", "ToolDefinitionError"), ("bad name", "ToolDefinitionError"), ("bad target", "ToolDefinitionError"), ("long description", "ToolDefinitionError"), ("control character", "ToolDefinitionError"),
    ("one to many", "ToolDefinitionError"), ("api version", "ToolDefinitionError"), ("annotation without a form", "ToolDefinitionError"),
]


@query(values(DEFINED, "definition, outcome"))
def tool_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """What can be a tool, by signature and contract."""

    def conflict(value: int) -> int:
        return value

    def options(value: Any, *, x: Any = None, y: set | None = None) -> Any:
        return value

    given: dict[str, tuple[Callable, dict]] = {
        "fine": (lambda v, *, a=1: v, {}), "no parameter": (lambda: 1, {}), "default of the value": (lambda v=1: v, {}), "positional option": (lambda v, a: v, {}),
        "default without JSON": (lambda v, *, a=float("nan"): v, {}), "annotation conflict": (conflict, {"input": JsonType.STRING}), "bad name": (lambda v: v, {"name": "9x"}),
        "bad target": (lambda v: v, {"target": "row"}), "long description": (lambda v: v, {"description": "x" * 2049}), "control character": (lambda v: v, {"description": "a\x1bb"}),
        "one to many": (lambda v: v, {"cardinality": "one_to_many"}), "api version": (lambda v: v, {"api_version": 2}), "annotation without a form": (options, {}),
    }

    def outcome(f: Callable, options: dict) -> str:
        try:
            make_contract(f, **({"name": "t", "target": "value", "input": JsonType.ANY, "output": JsonType.ANY} | options))
            return "ok"
        except ToolDefinitionError as e:
            return type(e).__name__

    return cases(spark, [(n, outcome(*given[n])) for n, _ in DEFINED], "definition string, outcome string")


ANNOTATIONS = [("int", '"int"'), ("str|None", '{"union": ["str", "null"]}'), ("list[int]", '{"list": "int"}'), ("dict[str, float]", '{"dict": ["str", "float"]}'), ("Any", '"any"')]


@query(values(ANNOTATIONS, "annotation, form"))
def annotation_codec(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"int": int, "str|None": str | None, "list[int]": list[int], "dict[str, float]": dict[str, float], "Any": Any}
    rows = []
    for name, _ in ANNOTATIONS:
        form = annotation_to_json(kinds[name])
        assert annotation_to_json(annotation_from_json(form)) == form
        rows.append((name, json.dumps(form)))
    return cases(spark, rows, "annotation string, form string")



@query("SELECT p_partkey, upper(p_name) || '?' AS p_name FROM part")
def tool_value(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "part", columns=["p_partkey", "p_name"]), [program('shout(.p_name, suffix="?")', TOOLS)], "p_partkey long, p_name string")


@query("SELECT n_nationkey, n_name, 'web' AS source FROM nation")
def tool_record(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "nation"), [program("add_metadata(., source='web')", TOOLS)], "n_nationkey int, n_name string, source string")


@query("SELECT n_name, 'r' || n_regionkey AS n_regionkey FROM nation")
def tool_qualified(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "nation"), [program("my.stringify(.n_regionkey, prefix='r')", TOOLS)], "n_name string, n_regionkey string")


def _contract(name: str, expression: str, stage: str, actual: str) -> None:
    @query(f"SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, '{stage}' AS stage, '{actual}' AS actual_type FROM nation", name)
    def broken(spark: SparkSession, sf: str) -> DataFrame:
        rows = Pipeline([program(expression, TOOLS)]).results(spark, table(sf, "nation"))
        return typed(rows, "seq long, tool struct<stage: string, actual_type: string>", "error").select("seq", "tool.stage", "tool.actual_type")


_contract("contract_input_error", "shout(.n_nationkey)", "input", "integer")
_contract("contract_output_error", "number_out(.n_name)", "output", "integer")


@query("SELECT n_nationkey, CAST(length(n_name) AS INT) AS n_name FROM nation")
def validate_off(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, table(sf, "nation"), [program("number_out(.n_name)", TOOLS, "off")], "n_nationkey int, n_name int")


# -- Error policies ----------------------------------------------------------------------------------------------


def _fails_on_error(r: dict) -> dict:
    if r["event_id"] % 7 == 3:
        raise ValueError("seven")
    return r


EVENT = "event_id long, event_type string"


def _events(sf: str) -> ParquetSource:
    return table(sf, "events", columns=["event_id", "event_type"])


@query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 3")
def errors_skip(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/out.jsonl"
    Pipeline([_fails_on_error]).run(_events(sf), JsonlSink(out), errors="skip", spark=spark, runtime=RuntimeContext())
    return spark.read.schema(EVENT).json(out)


ERRORS = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, 'ValueError' AS error_type, 'seven' AS error_message, '_fails_on_error' AS stage_name FROM events QUALIFY event_id % 7 = 3"
ERROR = "seq long, error_type string, error_message string, stage_name string"


@query(ERRORS)
def errors_return(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads go to a sink of their own."""
    out = folder(spark)
    Pipeline([_fails_on_error]).run(_events(sf), JsonlSink(f"{out}/good.jsonl"), errors="return", error_sink=JsonlSink(f"{out}/bad.jsonl"), spark=spark, runtime=RuntimeContext())
    return spark.read.schema(ERROR).json(f"{out}/bad.jsonl")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, CASE WHEN event_id % 7 = 3 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 7 = 3 THEN row_number() OVER (ORDER BY event_id) - 1 END AS seq FROM events")
def errors_return_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """Without a sink of their own, payloads stand in the sink at their records' places."""
    out = f"{folder(spark)}/out.jsonl"
    Pipeline([_fails_on_error]).run(_events(sf), JsonlSink(out), errors="return", spark=spark, runtime=RuntimeContext())
    lines = Pipeline([lambda r: [r.get("event_id"), r.get("seq")]]).results(spark, JsonlSource(out))
    x = F.from_json(F.col("value").cast("string"), "array<long>")
    return lines.select(F.col("seq").alias("line"), x[0].alias("event_id"), x[1].alias("seq"))


@query("SELECT count(*) AS input_records, count(*) FILTER (event_id % 7 <> 3) AS output_records, count(*) FILTER (event_id % 7 = 3) AS failed_records FROM events")
def errors_counted(spark: SparkSession, sf: str) -> DataFrame:
    seen = itertools.count()
    stats = Pipeline([_fails_on_error]).run(_events(sf), CallableSink(lambda r: next(seen)), errors="skip", ordered=False, spark=spark, runtime=RuntimeContext())
    assert next(seen) == stats.output_records and stats.elapsed_seconds > 0 and stats.records_per_second > 0
    return cases(spark, [(stats.input_records, stats.output_records, stats.failed_records)], "input_records long, output_records long, failed_records long")


@query("SELECT event_id, event_type FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 7 = 3)")
def errors_raise_prefix(spark: SparkSession, sf: str) -> DataFrame:
    sink = ListSink()
    try:
        Pipeline([_fails_on_error]).run(table(sf, "events", columns=["event_id", "event_type"]), sink, spark=spark, runtime=RuntimeContext())
    except StageExecutionError as e:
        assert e.record_seq is not None
    return spark.createDataFrame([(r["event_id"], r["event_type"]) for r in sink.records], EVENT)


# -- Sharding ----------------------------------------------------------------------------------------------------


def _shards(name: str, sharding: Any, sql: str) -> None:
    @query(f"SELECT o_orderkey, CAST({sql} AS INT) AS rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, count(*) OVER () AS n FROM orders)", f"shard_{name}")
    def shards(spark: SparkSession, sf: str) -> DataFrame:
        lines = _key_lines(spark, sf)
        total = spark.read.text(lines.path).count()
        out = None
        for rank in range(1 if isinstance(sharding, NoSharding) else 4):
            how = RangeSharding(total) if isinstance(sharding, RangeSharding) else sharding
            part = run(spark, lines, [TransformStage(dict)], "o_orderkey long", runtime=RuntimeContext(rank, 4), sharding=how).withColumn("rank", F.lit(rank))
            out = part if out is None else out.unionAll(part)
        return out


def _key_lines(spark: SparkSession, sf: str) -> JsonlSource:
    path = f"{folder(spark)}/orders.jsonl"
    Pipeline([lambda r: r]).run(table(sf, "orders", columns=["o_orderkey"]), JsonlSink(path), spark=spark, runtime=RuntimeContext())
    return JsonlSource(path)


_shards("none", NoSharding(), "0")
_shards("modulo", ModuloSharding(), "seq % 4")
_shards("hash", HashSharding(lambda r: str(r["o_orderkey"])), "('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT % 4")
_shards("range", RangeSharding(), "CASE WHEN seq < (n % 4) * (n // 4 + 1) THEN seq // (n // 4 + 1) ELSE (n % 4) + (seq - (n % 4) * (n // 4 + 1)) // (n // 4) END")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/nation"
    spark.read.parquet(f"{sf}/nation.parquet").repartition(5).write.parquet(out)
    parts = [run(spark, ParquetSource(out), [lambda r: r], NATION, runtime=RuntimeContext(rank, 3)) for rank in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT range * 2 AS x FROM range(1000)")
def iterable_source(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, IterableSource(range(1000)), [lambda x: {"x": x * 2}], "x long")


@query("SELECT o_orderkey, CAST((rn // 1000) % 3 AS INT) AS rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)")
def shard_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A single file's row groups, a thousand records each, are dealt to three ranks."""
    out = f"{folder(spark)}/orders.parquet"
    schema = pa.schema([("o_orderkey", pa.int64())])
    Pipeline([lambda r: r]).run(table(sf, "orders", columns=["o_orderkey"]), ParquetSink(out, schema=schema, batch_size=1000), spark=spark, runtime=RuntimeContext())
    parts = [run(spark, ParquetSource(out), [lambda r: r], "o_orderkey long", runtime=RuntimeContext(rank, 3)).withColumn("rank", F.lit(rank)) for rank in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT count(*) AS whole, count(*) AS with_filter FROM lineitem")
def parquet_total(spark: SparkSession, sf: str) -> DataFrame:
    """By the footers, whatever the filters; filtered and sharded, nobody knows."""
    filtered = table(sf, "lineitem", filters=("l_quantity", ">", 10.0))
    assert filtered.total(runtime=RuntimeContext(1, 3)) is None
    return cases(spark, [(table(sf, "lineitem").total(), filtered.total())], "whole long, with_filter long")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def parquet_filtered_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """A source's filter and a front stage's, both in the scan of a pipeline with Python."""
    source = table(sf, "customer", columns=["c_custkey", "c_acctbal"])
    return run(spark, source, [FilterStage(F.col("c_acctbal") < 0), lambda r: {"c_custkey": r["c_custkey"]}], "c_custkey long")


class Squares(Source):
    """A source of one's own that only iterates, with a record that it can't read, and deals out its records itself."""

    def __iter__(self):
        for k in range(1000):
            yield SourceRecordError(ValueError("unreadable")) if k % 10 == 9 else {"k": k, "square": k * k}

    def iter_shard(self, rank: int, world_size: int):
        return (x for n, x in enumerate(self) if n % world_size == rank)


@query("SELECT range AS k, range * range AS square FROM range(1000) WHERE range % 10 <> 9")
def source_of_ones_own(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, Squares(), [TransformStage(dict)], "k long, square long")


@query("SELECT range AS k, CAST(range % 3 AS INT) AS rank FROM range(1000) WHERE range % 10 <> 9")
def source_own_shards(spark: SparkSession, sf: str) -> DataFrame:
    parts = [run(spark, Squares(), [TransformStage(dict)], "k long", runtime=RuntimeContext(rank, 3)).withColumn("rank", F.lit(rank)) for rank in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


FORMATS = [("jsonl:a.parquet", "jsonl"), ("parquet:a", "parquet"), ("a.parquet", "parquet"), ("a.jsonl", "jsonl"), ("a.jsonl.gz", "jsonl"), ("a.ndjson", "jsonl"), ("s3://x/a.parquet", "parquet"), ("folder", "jsonl")]


@query(values(FORMATS, "given, format"))
def path_formats(spark: SparkSession, sf: str) -> DataFrame:
    local = [x for x in FORMATS if "://" not in x[0]]
    rows = [(x, split_format(x)[0]) for x, _ in local] + [(x, "parquet" if x.endswith(".parquet") else "jsonl") for x, _ in FORMATS if "://" in x]
    return cases(spark, rows, "given string, format string")


LAUNCHED = [("none", "local", 0, 1, 0), ("torchrun", "torchrun", 1, 4, 1), ("slurm", "slurm", 2, 8, 1), ("k8s", "k8s", 3, 5, 1), ("both", "torchrun", 0, 2, 1), ("half", "local", 0, 1, 1)]


@query(values(LAUNCHED, "launcher, environment, rank, world, aware"))
def runtime_detection(spark: SparkSession, sf: str) -> DataFrame:
    import os

    given = {
        "none": {}, "torchrun": {"RANK": "1", "WORLD_SIZE": "4"}, "slurm": {"SLURM_PROCID": "2", "SLURM_NTASKS": "8"}, "k8s": {"JOB_COMPLETION_INDEX": "3", "WORLD_SIZE": "5"},
        "both": {"RANK": "0", "WORLD_SIZE": "2", "SLURM_PROCID": "1", "SLURM_NTASKS": "3"}, "half": {"RANK": "1"},
    }
    known = {v for names in model.LAUNCHERS.values() for v in names.values()} | {"LOCAL_WORLD_SIZE"}
    kept, rows = {k: os.environ.pop(k) for k in known & set(os.environ)}, []
    try:
        for name, _, _, _, _ in LAUNCHED:
            os.environ.update(given[name])
            found = RuntimeContext.auto()
            rows.append((name, found.environment, found.rank, found.world_size, int(model.is_rank_aware_env())))
            for k in given[name]:
                del os.environ[k]
    finally:
        os.environ.update(kept)
    return cases(spark, rows, "launcher string, environment string, rank int, world int, aware int")


REFUSED = [("no stage", "PipelineValidationError"), ("not callable", "PipelineValidationError"), ("name twice", "PipelineValidationError"), ("policy", "PipelineValidationError"), ("in flight", "PipelineValidationError"), ("no file", "SourceError"), ("filter", "ParquetError"), ("rank", "RuntimeDetectionError"), ("range without total", "ShardingError"), ("closed sink", "SinkError"), ("setup", "setup of stage 'Broken' failed"), ("fatal source", "OSError")]


@query(values(REFUSED, "what, outcome"))
def errors_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What no policy skips: options, sources, sinks, setups."""

    class Broken(GenericStage):
        def setup(self, context):
            raise ValueError("no")

    def fatal():
        yield 1
        raise OSError("gone")

    def go(stages=(lambda x: x,), source=(1,), sink=None, **options):
        Pipeline(list(stages)).run(source, sink or ListSink(), spark=spark, **({"runtime": RuntimeContext(), "errors": "skip"} | options))

    given: dict[str, Callable[[], Any]] = {
        "no stage": lambda: Pipeline([]), "not callable": lambda: Pipeline([1]), "name twice": lambda: Pipeline([TransformStage(len, name="a"), TransformStage(len, name="a")]),
        "policy": lambda: go(errors="no"), "in flight": lambda: go(max_in_flight=0), "no file": lambda: go(source=f"{folder(spark)}/none.jsonl"), "filter": lambda: ParquetSource("x", filters=("a", "~", 1)),
        "rank": lambda: RuntimeContext(3, 3), "range without total": lambda: go(source=iter([1]), runtime=RuntimeContext(0, 2), sharding=RangeSharding()),
        "closed sink": lambda: JsonlSink(f"{folder(spark)}/x.jsonl").write_rows(spark.range(1), RuntimeContext(), True), "setup": lambda: go([Broken(process=len)]), "fatal source": lambda: go(source=fatal()),
    }
    rows = []
    for name, said in REFUSED:
        try:
            given[name]()
            rows.append((name, "nothing"))
        except Exception as e:  # noqa: BLE001  all of them are the result
            rows.append((name, said if " " in said and said in str(e) else type(e).__name__))
    return cases(spark, rows, "what string, outcome string")


@query(values([(0, "clean", "TransformStage", None), (1, "FilterStage", "FilterStage", None), (2, "ToolProgramStage", "ToolProgramStage", "tojson(.a)")], "position, name, kind, expression"))
def pipeline_inspection(spark: SparkSession, sf: str) -> DataFrame:
    rows = report(Pipeline([TransformStage(dict, name="clean"), FilterStage(F.col("a") > 1), program("tojson(.a)")]))
    return cases(spark, [(r["index"], r["name"], r["kind"], r.get("expression")) for r in rows], "position int, name string, kind string, expression string")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 2 = 0")
def command_line(spark: SparkSession, sf: str) -> DataFrame:
    """``transform`` as the shell calls it: the even events go through an expression, the others can't be read."""
    out = folder(spark)
    lines = Pipeline([lambda r: json.dumps(r) if r["event_id"] % 2 == 0 else "NOT JSON"])
    lines.run(table(sf, "events", columns=EVENTS), JsonlSink(f"{out}/in.jsonl", raw=True), spark=spark, runtime=RuntimeContext())
    flags = ["--errors", "return", "--error-output", f"{out}/bad.jsonl", "--no-progress", "--rank", "0", "--world-size", "1", "--validate-tools", "sample"]
    if cli.main(["transform", "fromjson(.props)", f"{out}/in.jsonl", f"{out}/out.jsonl", *flags]):
        raise RecordmillError("the command failed")
    return spark.read.schema("event_id long, props struct<k: long>").json(f"{out}/out.jsonl").select("event_id", "props.k")


@query(values([("started", 10000), ("processed", 10000), ("dropped", 5000), ("closed", 1)], "event, n").replace("10000", "(SELECT count(*) FROM events)").replace("5000", "(SELECT count(*) FROM events WHERE event_id % 2 = 1)"))
def progress_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What a reporter of one's own is told: the total, what is done, and the end."""
    from recordmill.progress import ProgressReporter

    told: dict[str, int] = {"processed": 0}

    class Told(ProgressReporter):
        def start(self, total=None):
            told["started"] = total

        def update(self, n=1, snapshot=None, **stats):
            told["processed"] += n
            told["dropped"] = snapshot.dropped
            assert snapshot.submitted - snapshot.processed == snapshot.in_flight == 0

        def close(self):
            told["closed"] = 1

    Pipeline([FilterStage(lambda r: r["event_id"] % 2 == 0)]).run(_events(sf), ListSink(), progress_reporter=Told(), spark=spark, runtime=RuntimeContext())
    return cases(spark, list(told.items()), "event string, n long")


# -- The flagship ------------------------------------------------------------------------------------------------


def _normalise(r: dict) -> dict:
    return r | {"text": r["text"].strip()}


def _score(r: dict) -> dict:
    return {"doc_id": r["doc_id"], "n": len(r["text"])}


@query("SELECT doc_id, length(trim(text)) AS n FROM documents WHERE trim(text) <> ''")
def normalize_score(spark: SparkSession, sf: str) -> DataFrame:
    """Normalise, filter, score: three Python stages fused into one boundary."""
    return run(spark, table(sf, "documents", columns=["doc_id", "text"]), [_normalise, FilterStage(lambda r: r["text"]), _score], "doc_id long, n long")


@query("SELECT doc_id, length(trim(text)) AS n FROM documents WHERE trim(text) <> ''")
def normalize_score_native(spark: SparkSession, sf: str) -> DataFrame:
    """The same under Catalyst alone."""
    df = table(sf, "documents", columns=["doc_id", "text"]).native(spark)
    for s in (TransformStage({"text": F.trim("text")}), FilterStage(F.col("text") != ""), TransformStage({"n": F.char_length("text").cast("long")})):
        df = s.native(df)
    return df.select("doc_id", "n")
