import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recordmill import (
    DROP, CallableSink, FilterStage, GenericStage, HashSharding, IterableSource, JsonlSink, JsonlSource, ListSink, ModuloSharding, ParquetSink, ParquetSource,
    Pipeline, RangeSharding, RuntimeContext, SourceRecordError, Stage, TransformStage, compile_expression,
)
from recordmill import cli, model
from recordmill.errors import ParquetError, PipelineValidationError, RuntimeDetectionError, ShardingError, SinkError, SourceError, StageExecutionError
from recordmill.sources.base import Source
from recordmill.streaming import stream_results, write_lines
from recordmill.tools.provider import ProviderError
from recordmill.tools.registry import Registry


def run(spark, stages, source, sink=None, **options):
    sink = sink or ListSink()
    return Pipeline(stages).run(source, sink, spark=spark, **options), getattr(sink, "records", None)


def fails(bad):
    def stage(x):
        if x in bad:
            raise ValueError(f"bad {x}")
        return x

    return stage


def test_values_drops_and_none(spark):
    stats, got = run(spark, [lambda x: None if x == 1 else x, FilterStage(lambda x: x != 2), GenericStage(process=lambda x: DROP if x == 3 else x)], range(6))
    assert got == [0, None, 4, 5]
    assert (stats.input_records, stats.output_records, stats.dropped_records, stats.failed_records) == (6, 4, 2, 0)


def test_policies(spark):
    stats, got = run(spark, [fails({3, 7})], range(10), errors="skip")
    assert got == [0, 1, 2, 4, 5, 6, 8, 9] and stats.failed_records == 2
    stats, got = run(spark, [fails({3})], range(5), errors="return")
    assert got[:3] == [0, 1, 2] and got[3]["error_type"] == "ValueError" and got[3]["seq"] == 3 and got[3]["stage_name"] == "stage" and stats.output_records == 5
    errors = ListSink()
    _, got = run(spark, [fails({3})], range(5), errors="return", error_sink=errors)
    assert got == [0, 1, 2, 4] and [e["error_message"] for e in errors.records] == ["bad 3"]
    sink = ListSink()
    with pytest.raises(StageExecutionError) as e:
        run(spark, [fails({3, 1})], range(5), sink)
    assert e.value.record_seq == 1 and sink.records == [0]
    with pytest.raises(PipelineValidationError):
        run(spark, [fails({3})], range(5), errors="no")


def test_bad_records_of_a_source(spark):
    items = [1, SourceRecordError(ValueError("unreadable"), {"line": 2}), 3]
    stats, got = run(spark, [lambda x: x], IterableSource(items), errors="skip")
    assert got == [1, 3] and stats.failed_records == 1


def test_names_and_validation():
    p = Pipeline([TransformStage(len), TransformStage(len), TransformStage(str, name="len_2")])
    assert [s.name for s in p.stages] == ["len", "len_3", "len_2"]
    for bad in ([], [1], [TransformStage(len, name="a"), TransformStage(str, name="a")]):
        with pytest.raises(PipelineValidationError):
            Pipeline(bad)


def test_setup_and_context(spark):
    class Counting(Stage):
        def setup(self, context):
            self.n = 100

        def process(self, value, context):
            return value + self.n + context.record_index

    assert run(spark, [Counting()], range(3))[1] == [100, 102, 104]


def lines(path, rows):
    path.write_text("".join(f"{r}\n" for r in rows))
    return str(path)


@pytest.mark.parametrize("ending", [".jsonl", ".jsonl.gz", ".jsonl.zst"])
def test_jsonl_round_trip_in_order(spark, tmp_path, ending):
    rows = [{"i": i, "é": "ü"} for i in range(50)]
    run(spark, [lambda r: r], rows, JsonlSink(str(tmp_path / f"x{ending}")))
    assert run(spark, [lambda r: r], str(tmp_path / f"x{ending}"))[1] == rows
    raw = run(spark, [lambda r: r], JsonlSource(str(tmp_path / f"x{ending}"), raw=True))[1]
    assert raw == [json.dumps(r) for r in rows]


def test_jsonl_blank_lines_are_errors(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", ['{"a": 1}', "", "NOT JSON", '{"a": 2}'])
    stats, got = run(spark, [lambda r: r], path, errors="skip")
    assert got == [{"a": 1}, {"a": 2}] and stats.failed_records == 2
    _, got = run(spark, [lambda r: r], path, errors="return")
    assert [g.get("seq") for g in got] == [None, 1, 2, None]
    with pytest.raises(SourceError):
        run(spark, [lambda r: r], str(tmp_path / "none"))


def test_directories_and_shards(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(4):
        lines(tmp_path / "d" / f"{k}.jsonl", [json.dumps({"shard": k, "j": j}) for j in range(10)])
    whole = run(spark, [lambda r: (r["shard"], r["j"])], str(tmp_path / "d"))[1]
    assert whole == [(k, j) for k in range(4) for j in range(10)]
    parts = [run(spark, [lambda r: (r["shard"], r["j"])], str(tmp_path / "d"), runtime=RuntimeContext(r, 2))[1] for r in range(2)]
    assert parts[0] == [x for x in whole if x[0] % 2 == 0] and sorted(parts[0] + parts[1]) == whole
    run(spark, [lambda r: r], str(tmp_path / "d"), JsonlSink(str(tmp_path / "out") + "/"))
    out = sorted((tmp_path / "out").iterdir())
    assert all(p.name.startswith("part-") and p.name.endswith(".jsonl") for p in out)
    again = [json.loads(x) for p in out for x in p.read_text().splitlines()]
    assert [(r["shard"], r["j"]) for r in again] == whole


@pytest.mark.parametrize("how", [ModuloSharding(), HashSharding(lambda x: x), RangeSharding()])
def test_logical_shards(spark, how):
    parts = [run(spark, [lambda x: x], range(23), runtime=RuntimeContext(r, 4), sharding=how)[1] for r in range(4)]
    assert sorted(sum(parts, [])) == list(range(23))
    if isinstance(how, HashSharding):
        assert parts[1] == [x for x in range(23) if int.from_bytes(hashlib.sha256(repr(x).encode()).digest()[:8], "big") % 4 == 1]
    if isinstance(how, RangeSharding):
        assert [len(p) for p in parts] == [6, 6, 6, 5] and parts[1] == list(range(6, 12))


def test_ranges_need_a_total(spark):
    with pytest.raises(ShardingError):
        run(spark, [lambda x: x], iter(range(5)), runtime=RuntimeContext(0, 2), sharding=RangeSharding())


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"id": range(100), "text": [f"t{i}" for i in range(100)]}), path, row_group_size=10)
    assert run(spark, [lambda r: r["text"]], ParquetSource(path, filters=("id", ">=", 98)))[1] == ["t98", "t99"]
    assert run(spark, [lambda r: r], ParquetSource(path, columns=["text"], filters=[("id", "in", [3, 5]), ("id", "<", 5)]))[1] == [{"text": "t3"}]
    parts = [run(spark, [lambda r: r["id"]], ParquetSource(path), runtime=RuntimeContext(r, 3))[1] for r in range(3)]
    assert parts[0][:11] == [*range(10), 30] and sorted(sum(parts, [])) == list(range(100))
    assert ParquetSource(path).total() == 100 and ParquetSource(path).total(runtime=RuntimeContext(1, 3)) == 30
    for bad in (("id", "~", 1), [("id", "==")], "id > 3", []):
        with pytest.raises(ParquetError):
            ParquetSource(path, filters=bad)
    stats, _ = run(spark, [FilterStage(F.col("id") < 5), TransformStage({"x": F.col("id") * 2})], ParquetSource(path), ParquetSink(str(tmp_path / "o.parquet")))
    assert (stats.input_records, stats.dropped_records) == (100, 95)
    assert pq.read_table(tmp_path / "o.parquet").column("x").to_pylist() == [0, 2, 4, 6, 8]
    run(spark, [lambda r: {"a": r["id"], "b": r["text"]}], ParquetSource(path), ParquetSink(str(tmp_path / "typed.parquet"), schema=pa.schema([("a", pa.int32()), ("b", pa.string())])))
    back = pq.read_table(tmp_path / "typed.parquet")
    assert back.column("a").to_pylist() == list(range(100)) and back.schema.field("a").type == pa.int32()


def test_filters_reach_the_scan(spark):
    df = ParquetSource("/root/testdata/sf0.001/orders.parquet", columns=["o_orderkey"], filters=("o_totalprice", ">", 1000.0)).native(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderstatus" not in plan


def test_stages_are_fused_into_one_boundary(spark):
    rows = Pipeline([lambda r: r, FilterStage(bool), lambda r: r]).results(spark, [1, 2])
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_sinks(spark, tmp_path):
    seen = []
    run(spark, [lambda x: x], range(4), CallableSink(seen.append))
    assert seen == [0, 1, 2, 3]
    with pytest.raises(SinkError):
        run(spark, [lambda x: {1, 2}], range(2), JsonlSink(str(tmp_path / "x.jsonl")))


def test_runtime(monkeypatch):
    for name in ("RANK", "WORLD_SIZE", "SLURM_PROCID", "SLURM_NTASKS", "JOB_COMPLETION_INDEX"):
        monkeypatch.delenv(name, raising=False)
    assert RuntimeContext.auto().environment == "local" and not model.is_rank_aware_env()
    monkeypatch.setenv("SLURM_PROCID", "2")
    monkeypatch.setenv("SLURM_NTASKS", "4")
    assert RuntimeContext.auto() == RuntimeContext(2, 4, environment="slurm")
    monkeypatch.setenv("RANK", "1")
    monkeypatch.setenv("WORLD_SIZE", "3")
    assert RuntimeContext.auto(rank=0).rank == 0 and RuntimeContext.auto().environment == "torchrun"
    with pytest.raises(RuntimeDetectionError):
        RuntimeContext(3, 3)


PROVIDER = '''
from recordmill import Example, JsonType, tool

@tool(name="double", input=JsonType.INTEGER, output=JsonType.INTEGER, examples=[Example(2, 4)])
def double(value, *, plus: int = 0):
    return 2 * value + plus
'''


def test_providers(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("RECORDMILL_HOME", str(tmp_path / "home"))
    path = tmp_path / "mine.py"
    path.write_text(PROVIDER)
    registry = Registry()
    assert registry.install(path).tools[0].name == "double"
    with pytest.raises(ProviderError):
        registry.install(path)
    with pytest.raises(ProviderError):
        registry.install(path, provider_id="other", alias="mine")
    source, out = lines(tmp_path / "in.jsonl", ['{"a": 1}', '{"a": "x"}']), tmp_path / "out.jsonl"
    assert cli.main(["double(.a, plus=1)", source, str(out), "--errors", "skip"]) == 0
    assert out.read_text() == '{"a": 3}\n'
    compiled = compile_expression("mine.double(.a)", registry)
    registry.install(path, provider_id="second")
    with pytest.raises(Exception, match="several providers"):
        compile_expression("double(.a)", registry)
    place = registry.providers()[0].path
    with open(place, "a") as f:
        f.write("# changed\n")
    with pytest.raises(ProviderError, match="digest"):
        from recordmill.dsl.compiler import Program

        Program(compile_expression("mine.double(.a)", registry))
    assert compiled.invocations[0].descriptor.source == PROVIDER.encode()
    registry.remove("second")
    assert [p.provider_id for p in registry.providers()] == ["mine"]


@pytest.mark.parametrize("text, said", [("x = ", "UTF-8 Python"), ("x = 1", "no tool"), (PROVIDER.replace("(2, 4)", "(2, 5)"), "example 0"), (PROVIDER + "\nraise ValueError('no')", "imported"), (PROVIDER.replace("double", "not-a-name", 1), "not a tool name")])
def test_bad_providers(tmp_path, text, said):
    path = tmp_path / "bad.py"
    path.write_text(text)
    with pytest.raises(ProviderError, match=said):
        Registry(tmp_path / "home").install(path)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("RECORDMILL_HOME", str(tmp_path / "home"))
    source = lines(tmp_path / "in.jsonl", ['{"v": "{\\"k\\": 1}"}', '{"v": "bad"}', "NOT JSON"])
    out, bad = tmp_path / "out.jsonl", tmp_path / "bad.jsonl"
    assert cli.main(["transform", "fromjson(.v)", source, str(out), "--errors", "return", "--error-output", str(bad)]) == 0
    assert out.read_text() == '{"v": {"k": 1}}\n'
    found = [json.loads(x) for x in bad.read_text().splitlines()]
    assert [(e["seq"], e["stage_name"]) for e in found] == [(1, "ToolProgramStage"), (2, "JsonLoadStage")] and found[0]["tool"]["stage"] == "call"
    assert cli.main(["fromjson(.v)", source, str(out)]) == 1
    assert cli.main(["inspect-expression", "fromjson(.v) | tojson(.v)", "--json"]) == 0
    assert cli.main(["nope(.v)", source, str(out)]) == 1
    program = tmp_path / "prog.py"
    program.write_text("from recordmill import Pipeline\np = Pipeline([lambda r: {'n': len(r)}])\n")
    good = lines(tmp_path / "good.jsonl", ['{"a": 1}'])
    assert cli.main(["run", f"{program}:p", "--source", f"jsonl:{good}", "--sink", str(tmp_path / "n.jsonl")]) == 0
    assert (tmp_path / "n.jsonl").read_text() == '{"n": 1}\n'
    assert cli.main(["inspect", f"{program}:p"]) == 0 and cli.main(["inspect", f"{program}:q"]) == 1
    assert cli.main(["tools", "list"]) == 0 and "fromjson" in capsys.readouterr().out


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", ['{"a": 1}', "bad"])
    results = stream_results(spark, str(tmp_path / "in"), Pipeline([lambda r: r]))
    q = write_lines(results, str(tmp_path / "out"), str(tmp_path / "cp"), errors=str(tmp_path / "err"))
    q.awaitTermination()
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a": 1}']
    assert spark.read.text(str(tmp_path / "err")).count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_of_pipelines_reach_the_scan(spark):
    source = ParquetSource("/root/testdata/sf0.001/orders.parquet", columns=["o_orderkey"], filters=("o_totalprice", ">", 1000.0))
    assert "GreaterThan(o_totalprice,1000.0)" in plan_of(Pipeline([lambda r: r]).results(spark, source))
    plain = ParquetSource("/root/testdata/sf0.001/orders.parquet", columns=["o_orderkey", "o_totalprice"])
    plan = plan_of(Pipeline([FilterStage(F.col("o_totalprice") > 1000.0), lambda r: r]).results(spark, plain))
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderstatus" not in plan


@pytest.mark.parametrize("how", [ModuloSharding(), RangeSharding(200), HashSharding(lambda x: str(x["i"]))])
def test_shards_shuffle_no_records(spark, tmp_path, how):
    path = lines(tmp_path / "a.jsonl", [json.dumps({"i": i}) for i in range(200)])
    plan = plan_of(Pipeline([lambda r: r]).results(spark, path, runtime=RuntimeContext(1, 3), sharding=how))
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_numbers_count_after_filters(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        pq.write_table(pa.table({"id": range(100 * k, 100 * k + 100)}), str(tmp_path / "d" / f"{k}.parquet"), row_group_size=10)
    rows = Pipeline([lambda r: r["id"]]).results(spark, ParquetSource(str(tmp_path / "d"), filters=("id", "in", [5, 150, 299, 7])))
    assert sorted((r.seq, int(r.value)) for r in rows.collect()) == [(0, 5), (1, 7), (2, 150), (3, 299)]
    rows = Pipeline([FilterStage(F.col("id") % 100 == 1), lambda r: r["id"]]).results(spark, ParquetSource(str(tmp_path / "d")))
    assert sorted((r.seq, int(r.value)) for r in rows.collect()) == [(1, 1), (101, 101), (201, 201)]
    got = []
    for rank in range(4):
        _, part = run(spark, [lambda x: x], range(40), runtime=RuntimeContext(rank, 4), sharding=HashSharding(lambda x: x))
        rows = Pipeline([lambda x: x]).results(spark, range(40), runtime=RuntimeContext(rank, 4), sharding=HashSharding(lambda x: x)).collect()
        assert [int(r.value) for r in sorted(rows)] == part and [r.seq for r in sorted(rows)] == list(range(len(part)))
        got += part
    assert sorted(got) == list(range(40))


def test_many_records_of_an_iterable_go_to_scratch(spark, monkeypatch):
    from recordmill.sources import local

    monkeypatch.setattr(local, "HELD", 10)
    assert run(spark, [lambda x: x], (x for x in range(95)))[1] == list(range(95))
    parts = [run(spark, [lambda x: x], range(95), runtime=RuntimeContext(r, 3), sharding=HashSharding(lambda x: x))[1] for r in range(3)]
    assert sorted(sum(parts, [])) == list(range(95)) and all(p == sorted(p) for p in parts)


def test_uris(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [{"i": i} for i in range(20)]
    run(spark, [lambda r: r], rows, JsonlSink(f"{place}/x.jsonl.gz"))
    assert run(spark, [lambda r: r], f"{place}/x.jsonl.gz")[1] == rows
    run(spark, [lambda r: r], rows, ParquetSink(f"{place}/x.parquet"))
    assert ParquetSource(f"{place}/x.parquet").total() == 20 and list(ParquetSource(f"{place}/x.parquet")) == rows
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.away.link./in", place)
    assert run(spark, [lambda r: r["i"]], ParquetSource("viewfs://away/in/x.parquet"))[1] == list(range(20))
    run(spark, [lambda r: r], rows, JsonlSink(f"{place}/d/"))
    assert run(spark, [lambda r: r], JsonlSource("viewfs://away/in/d"))[1] == rows


def test_a_sink_of_one_file_has_its_records_made_by_many_tasks(spark, tmp_path):
    source = lines(tmp_path / "a.jsonl", [json.dumps({"i": i}) for i in range(100)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:

        def where(r, context):
            return {"task": context.worker_id, "bad": 1 // (r["i"] % 10)}

        run(spark, [GenericStage(process=where, with_context=True)], source, JsonlSink(str(tmp_path / "b.jsonl")), errors="skip")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [json.loads(x) for x in (tmp_path / "b.jsonl").read_text().splitlines()]
    assert len(got) == 90 and len({r["task"] for r in got}) > 1


def test_nothing_to_write(spark, tmp_path):
    run(spark, [FilterStage(lambda r: False)], [{"a": 1}], ParquetSink(str(tmp_path / "x.parquet")))
    assert pq.read_table(tmp_path / "x.parquet").num_rows == 0
    run(spark, [FilterStage(lambda r: False)], [{"a": 1}], JsonlSink(str(tmp_path / "x.jsonl")))
    assert (tmp_path / "x.jsonl").read_text() == ""


class Letters(Source):
    """A source of one's own that is opened and closed."""

    def __init__(self):
        self.said = []

    def open(self, runtime):
        self.said.append("open")

    def close(self):
        self.said.append("close")

    def __iter__(self):
        yield from "abc"
        raise SourceRecordError(ValueError("torn"))


def test_sources_of_ones_own(spark):
    source = Letters()
    stats, got = run(spark, [str.upper], source, errors="skip")
    assert got == ["A", "B", "C"] and stats.failed_records == 1 and source.said == ["open", "close"]


def test_streams_that_repeat_a_batch_write_it_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", ['{"a": 1}', '{"a": 2}'])
    results = stream_results(spark, str(tmp_path / "in"), Pipeline([lambda r: r]))
    for k in range(2):  # a lost checkpoint makes the first batch come again
        write_lines(results, str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a": 1}', '{"a": 2}']


def test_a_failed_install_leaves_what_was_there(tmp_path, monkeypatch):
    import os

    path = tmp_path / "mine.py"
    path.write_text(PROVIDER)
    registry = Registry(tmp_path / "home")
    first = registry.install(path)
    path.write_text(PROVIDER.replace("2 * value", "value + value"))
    real = os.replace

    def broken(a, b):
        if str(b).endswith("registry.json"):
            raise OSError("disk full")
        real(a, b)

    monkeypatch.setattr(os, "replace", broken)
    with pytest.raises(OSError):
        registry.install(path, force=True)
    monkeypatch.undo()
    assert registry.providers() == [first] and [p.name for p in (tmp_path / "home" / "providers" / "mine").iterdir()] == [f"{first.digest[:16]}.py"]
    second = registry.install(path, force=True)
    assert [p.name for p in (tmp_path / "home" / "providers" / "mine").iterdir()] == [f"{second.digest[:16]}.py"]


def test_providers_see_little_of_the_environment(tmp_path, monkeypatch):
    monkeypatch.setenv("A_SECRET", "x")
    path = tmp_path / "mine.py"
    path.write_text("import os\nassert 'A_SECRET' not in os.environ\n" + PROVIDER)
    assert Registry(tmp_path / "home").install(path).tools[0].name == "double"
    path.write_text("import os\nimport sys\nif 'Descriptor' in sys.modules['__main__'].__dict__: raise ValueError('spawned')\n" + PROVIDER)
    with pytest.raises(ProviderError, match="imported"):
        Registry(tmp_path / "other").install(path)


def test_sinks_on_the_driver_fetch_parts_of_bounded_size(spark, monkeypatch):
    from recordmill.sources import local

    monkeypatch.setattr(local, "FETCHED", 100)
    sizes, iterator = [], type(spark.range(1)).toLocalIterator

    def watched(self, *args):
        sizes.extend(self.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
        return iterator(self, *args)

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", watched)
    seen = []
    run(spark, [lambda x: x], range(5000), CallableSink(seen.append))
    assert seen == list(range(5000)) and sum(sizes) == 5000 and max(sizes) < 400
    seen.clear()
    run(spark, [lambda x: x], range(5000), CallableSink(seen.append), ordered=False)
    assert sorted(seen) == list(range(5000)) and max(sizes) < 400


def test_counting_errors_holds_no_record(spark, monkeypatch):
    """Each record that the sink is given is gone when the run ends."""
    import weakref

    from recordmill import queries

    given, left = [], []

    class Record(dict):
        pass

    class Watched(CallableSink):
        def __init__(self, fn):
            def watched(r):
                r = Record(r)
                given.append(weakref.ref(r))
                fn(r)

            super().__init__(watched)

        def close(self):
            left.append(sum(x() is not None for x in given))

    monkeypatch.setattr(queries, "CallableSink", Watched)
    (row,) = queries.errors_counted(spark, "/root/testdata/sf0.001").collect()
    assert len(given) == row.output_records > 0 and left == [0]


def test_thousands_of_uneven_row_groups_are_dealt_to_ranks(spark, tmp_path):
    path, at, want = str(tmp_path / "many.parquet"), 0, {0: [], 1: [], 2: []}
    with pq.ParquetWriter(path, pa.schema([("x", pa.int64())])) as w:
        for k in range(12_000):
            n = 40 if k % 997 == 5 else 1 + k % 3
            w.write_table(pa.table({"x": pa.array(range(at, at + n), pa.int64())}))
            want[k % 3] += range(at, at + n)
            at += n
    for rank in range(3):
        source, runtime = ParquetSource(path), RuntimeContext(rank, 3)
        assert [r.x for r in source.native(spark, runtime).orderBy("x").collect()] == want[rank]
        rows = Pipeline([lambda r: r["x"]]).results(spark, source, runtime=runtime).orderBy("seq").collect()
        assert [(r.seq, int(r.value)) for r in rows] == list(enumerate(want[rank]))
