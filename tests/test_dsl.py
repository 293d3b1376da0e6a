import json

import pytest

from recordmill.dsl.compiler import Program, compile_expression, matches
from recordmill.dsl.errors import ExpressionSyntaxError, SelectorResolutionError, ToolConfigurationError, ToolResolutionError
from recordmill.dsl.syntax import parse, rendered
from recordmill.functions.builtins import BUILTINS, fromjson, tojson
from recordmill.functions.types import JsonType, OneOf, compatible, is_json, type_name
from recordmill.queries import TOOLS, number_out, shout
from recordmill.tools.contract import ToolContract, ToolDefinitionError, annotation_from_json, annotation_to_json, contract_of, tool
from recordmill.tools.errors import ToolExecutionError
from recordmill.tools.registry import Resolved

NAMES = {n: Resolved("builtin", contract_of(f), function=f) for n, f in BUILTINS.items()} | TOOLS


def apply(expression, record, validate="always"):
    return Program(compile_expression(expression, NAMES), validate)(record, 0)


@pytest.mark.parametrize("text", [".", ".a", ".a.b", '.["x y"]', ".a[0]", ".a[]", '.a[].b["c.d"][2]', ".[0]"])
def test_selectors_render_as_written(text):
    assert rendered(parse(f"tojson({text})")[0].selector) == text


@pytest.mark.parametrize("text", ["", "tojson", "tojson(", "tojson(.a", "tojson(a)", "tojson(.a) tojson(.b)", "tojson(.a,)", "tojson(.a, x)", "tojson(.a[1.5])", 'tojson(.a, x="', "tojson(.a) |", "tojson(.a, x={1: 2})"])
def test_bad_syntax(text):
    with pytest.raises(ExpressionSyntaxError):
        parse(text)


def test_literals():
    call = parse(r"""t(., a="x\n\q\"", b='é', c=-2, d=1.5e3, e=[1, [true]], f={"k": null}, g=False, h=None)""")[0]
    assert [v for _, v, _ in call.arguments] == ['x\nq"', "é", -2, 1500.0, [1, [True]], {"k": None}, False, None]


def test_the_place_is_marked():
    with pytest.raises(ToolConfigurationError) as e:
        compile_expression("fromjson(.a) | tojson(.b, nope=1)", NAMES)
    lines = str(e.value).splitlines()
    assert lines[1][lines[2].index("^") :].startswith("nope=1") and lines[2].count("^") == 6


@pytest.mark.parametrize("text, error", [("none(.a)", ToolResolutionError), ("tojson(.a, compact=1)", ToolConfigurationError), ("tojson(.a, compact=true, compact=true)", ToolConfigurationError), ("add_metadata(.a, source='x')", ToolConfigurationError), ("add_metadata(.)", ToolConfigurationError), ("tojson(.a) | my.add_metadata(., source='x')", None), ("shout(.a) | stringify(.a)", None)])
def test_compile(text, error):
    if error:
        with pytest.raises(error):
            compile_expression(text, NAMES)
    else:
        compile_expression(text, NAMES)


def test_neighbours_that_can_not_fit():
    @tool("objects", input=JsonType.OBJECT, output=JsonType.OBJECT)
    def objects(x):
        return x

    names = NAMES | {"objects": Resolved("t", contract_of(objects), function=objects)}
    with pytest.raises(ToolConfigurationError):
        compile_expression("shout(.a) | objects(.a)", names)
    compile_expression("shout(.a) | objects(.b)", names)
    compile_expression("shout(.a[]) | objects(.a[])", names)


@pytest.mark.parametrize("record, selector", [({"a": 1}, ".b"), ({"a": 1}, ".a.b"), ({"a": [1]}, ".a[1]"), ({"a": [1]}, ".a[-1]"), ({"a": {}}, ".a[]"), ([1], ".a")])
def test_selectors_that_find_nothing(record, selector):
    with pytest.raises(SelectorResolutionError):
        matches([record], parse(f"tojson({selector})")[0].selector)
    with pytest.raises(ToolExecutionError) as e:
        apply(f"tojson({selector})", record)
    assert e.value.stage == "selector"


def test_programs():
    record = {"tools": json.dumps([{"name": "t1", "x": [1]}]), "metadata": {"annotation": '{"a": "[1, \\"2\\"]"}'}}
    got = apply("fromjson(.tools) | fromjson(.metadata.annotation, recursive=true) | tojson(.tools[].name)", record)
    assert got == {"tools": [{"name": '"t1"', "x": [1]}], "metadata": {"annotation": {"a": [1, "2"]}}}
    assert apply("tojson(.a[])", {"a": []}) == {"a": []}
    assert apply("tojson(.)", {"b": 1, "a": "é"}) == '{"b":1,"a":"é"}'


def test_fromjson():
    assert fromjson('{"a": "1"}') == {"a": "1"}
    assert fromjson('{"a": "1", "b": "x", "c": "[\\"2\\"]"}', recursive=True) == {"a": "1", "b": "x", "c": ["2"]}
    assert fromjson('{"a": "1"}', recursive=True, containers_only=False) == {"a": 1}
    assert fromjson({"a": "[]"}, recursive=True) == {"a": []}
    for bad, error in (([], TypeError), ("x", ValueError)):
        with pytest.raises(error):
            fromjson(bad)
    with pytest.raises(TypeError):
        fromjson(1, recursive=True)
    with pytest.raises(ToolExecutionError) as e:
        apply("fromjson(.a)", {"a": "NaN"})
    assert e.value.stage == "output"


def test_tojson():
    value = {"b": [1, 2.5, None], "a": "é"}
    assert tojson(value) == '{"b":[1,2.5,null],"a":"é"}'
    assert tojson(value, compact=False, sort_keys=True, ensure_ascii=True) == '{"a": "\\u00e9", "b": [1, 2.5, null]}'
    with pytest.raises(ValueError):
        tojson([float("nan")])


def test_contracts_are_checked_as_asked():
    with pytest.raises(ToolExecutionError) as e:
        apply("shout(.a)", {"a": 1})
    assert e.value.fields() == {
        "invocation_index": 0, "tool_name": "shout", "provider_id": "my", "expression_span": [0, 9], "selector": ".a", "matched_path": ".a",
        "match_ordinal": None, "expected_type": "string", "actual_type": "integer", "stage": "input",
    }
    p = Program(compile_expression("number_out(.)", NAMES), "sample")
    for _ in range(100):
        with pytest.raises(ToolExecutionError):
            p("abc")
    assert p("abc") == 3 and apply("number_out(.)", "abc", "off") == 3
    assert number_out("x") == 1 and shout("a") == "A!"


def test_types():
    assert JsonType.INTEGER.matches(10**40) and not JsonType.INTEGER.matches(True) and not JsonType.INTEGER.matches(1.0)
    assert not JsonType.NUMBER.matches(float("inf")) and not is_json({1: 2}) and not is_json([(1,)]) and is_json({"a": [None, True, 1.5]})
    assert OneOf(JsonType.STRING, OneOf(JsonType.NULL, JsonType.STRING)) == OneOf(JsonType.NULL, JsonType.STRING)
    assert compatible(JsonType.SCALAR, JsonType.NUMBER) and not compatible(JsonType.CONTAINER, JsonType.SCALAR)
    assert [type_name(x) for x in (None, True, 1, 1.5, "", [], {}, ())] == ["null", "boolean", "integer", "number", "string", "array", "object", "tuple"]
    with pytest.raises(ValueError):
        OneOf(JsonType.STRING)


def test_definitions():
    for bad in (lambda: None, lambda x=1: x, lambda x, y: x, lambda *a: a, lambda x, **k: x):
        with pytest.raises(ToolDefinitionError):
            tool("t")(bad)
    with pytest.raises(ToolDefinitionError):
        tool("t", cardinality="one_to_many")(lambda x: x)
    with pytest.raises(ToolDefinitionError):
        tool("not a name")(lambda x: x)
    c = contract_of(shout)
    assert ToolContract.from_json(json.loads(json.dumps(c.to_json()))) == c
    for a in (str, int | None, list[int], dict[str, bool], bool):
        assert annotation_from_json(annotation_to_json(a)) == a
    with pytest.raises(ToolDefinitionError):
        annotation_to_json(bytes)
