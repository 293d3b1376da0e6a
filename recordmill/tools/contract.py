"""What a tool takes and gives: the ``tool`` decorator and the contract it attaches."""

from __future__ import annotations

import enum
import inspect
import json
import re
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from recordmill.functions.types import PROBES, Contract, JsonType, OneOf, parse_type

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}\Z")
NO_DEFAULT = object()
API_VERSION = 1
#: Only one value for one value can be run; the other words are kept for later.
CARDINALITIES = ("one_to_one", "one_to_many", "zero_or_one")


class ToolDefinitionError(TypeError):
    """A function can't be a tool."""


@dataclass(frozen=True)
class Parameter:
    name: str
    annotation: Any = Any
    default: Any = NO_DEFAULT

    def accepts(self, x: Any) -> bool:
        return fits(x, self.annotation)


@dataclass(frozen=True)
class Example:
    input: Any
    output: Any
    arguments: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ToolContract:
    name: str
    target: str
    input: Contract
    output: Contract
    parameters: tuple[Parameter, ...] = ()
    api_version: int = API_VERSION
    cardinality: str = "one_to_one"
    deterministic: bool = True
    description: str = ""
    examples: tuple[Example, ...] = ()

    def __post_init__(self) -> None:
        if not NAME.match(self.name):
            raise ToolDefinitionError(f"not a tool name: {self.name!r}")
        if self.target not in ("value", "record"):
            raise ToolDefinitionError(f"a target is value or record, not {self.target!r}")
        for t in (self.input, self.output):
            if not isinstance(t, (JsonType, OneOf)):
                raise ToolDefinitionError(f"not a JSON type: {t!r}")
        if self.api_version != API_VERSION:
            raise ToolDefinitionError(f"API version {self.api_version!r} isn't known")
        if self.cardinality != "one_to_one":
            what = "isn't built yet" if self.cardinality in CARDINALITIES else "isn't known"
            raise ToolDefinitionError(f"cardinality {self.cardinality!r} {what}")
        if len(self.description) > 2048 or any((ord(c) < 32 or ord(c) == 127) and c not in "\n\t" for c in self.description):
            raise ToolDefinitionError("a description has at most 2048 characters and no control characters")

    def to_json(self) -> dict[str, Any]:
        return {
            "name": self.name, "target": self.target, "input": str(self.input), "output": str(self.output), "api_version": self.api_version,
            "cardinality": self.cardinality, "deterministic": self.deterministic, "description": self.description,
            "parameters": [{"name": p.name, "annotation": annotation_to_json(p.annotation)} | ({} if p.default is NO_DEFAULT else {"default": p.default}) for p in self.parameters],
            "examples": [{"input": e.input, "output": e.output, "arguments": e.arguments} for e in self.examples],
        }

    @classmethod
    def from_json(cls, x: dict[str, Any]) -> ToolContract:
        params = tuple(Parameter(p["name"], annotation_from_json(p["annotation"]), p.get("default", NO_DEFAULT)) for p in x["parameters"])
        rest = {k: x[k] for k in ("name", "target", "api_version", "cardinality", "deterministic", "description")}
        return cls(**rest, input=parse_type(x["input"]), output=parse_type(x["output"]), parameters=params, examples=tuple(Example(**e) for e in x["examples"]))


PLAIN = {"str": str, "int": int, "float": float, "bool": bool, "list": list, "dict": dict, "null": type(None)}


def fits(x: Any, a: Any) -> bool:
    """Whether a literal suits an annotation: an int is no float, a bool no number."""
    origin, args = typing.get_origin(a), typing.get_args(a)
    if a is Any:
        return True
    if origin in (typing.Union, types.UnionType):
        return any(fits(x, y) for y in args)
    if origin is typing.Literal:
        return any(type(x) is type(y) and x == y for y in args)
    if origin is list:
        return isinstance(x, list) and all(fits(y, args[0]) for y in x)
    if origin is dict:
        return isinstance(x, dict) and all(fits(k, args[0]) and fits(v, args[1]) for k, v in x.items())
    if isinstance(a, type) and issubclass(a, enum.Enum):
        return isinstance(x, a) or any(type(x) is type(m.value) and x == m.value for m in a)
    return type(x) is (type(None) if a is None else a)


def annotation_to_json(a: Any) -> Any:
    """An annotation as JSON; one that has no such form is an error, never "anything"."""
    origin, args = typing.get_origin(a), typing.get_args(a)
    if a is Any:
        return "any"
    if a is None:
        return "null"
    for name, kind in PLAIN.items():
        if a is kind:
            return name
    if origin in (typing.Union, types.UnionType):
        return {"union": [annotation_to_json(x) for x in args]}
    if origin is typing.Literal:
        return {"literal": list(args)}
    if origin is list:
        return {"list": annotation_to_json(args[0])}
    if origin is dict:
        return {"dict": [annotation_to_json(x) for x in args]}
    if isinstance(a, type) and issubclass(a, enum.Enum):
        return {"literal": [m.value for m in a]}
    raise ToolDefinitionError(f"parameters can't be annotated with {a!r}")


def annotation_from_json(x: Any) -> Any:
    if isinstance(x, str):
        return Any if x == "any" else PLAIN[x]
    ((kind, of),) = x.items()
    if kind == "union":
        return typing.Union[tuple(annotation_from_json(y) for y in of)]
    if kind == "literal":
        return typing.Literal[tuple(of)]
    if kind == "list":
        return list[annotation_from_json(of)]
    return dict[annotation_from_json(of[0]), annotation_from_json(of[1])]


def make_contract(fn: Callable, **given: Any) -> ToolContract:
    """The contract of a function: a value first, then keyword-only parameters with JSON defaults."""
    parameters = list(inspect.signature(fn, eval_str=True).parameters.values())
    if not parameters or parameters[0].kind not in (parameters[0].POSITIONAL_ONLY, parameters[0].POSITIONAL_OR_KEYWORD):
        raise ToolDefinitionError("a tool's first parameter is positional")
    if parameters[0].default is not inspect.Parameter.empty:
        raise ToolDefinitionError("a tool's first parameter has no default")
    first, found = parameters[0].annotation, []
    for p in parameters[1:]:
        if p.kind is not p.KEYWORD_ONLY:
            raise ToolDefinitionError(f"parameter {p.name!r} isn't keyword-only")
        annotation = Any if p.annotation is p.empty else p.annotation
        annotation_to_json(annotation)
        default = NO_DEFAULT
        if p.default is not p.empty:
            default = p.default.value if isinstance(p.default, enum.Enum) else p.default
            try:
                json.dumps(default, allow_nan=False)
            except (TypeError, ValueError):
                raise ToolDefinitionError(f"the default of {p.name!r} has no JSON form") from None
        found.append(Parameter(p.name, annotation, default))
    takes = given.get("input", JsonType.ANY)
    if first not in (inspect.Parameter.empty, Any) and isinstance(takes, (JsonType, OneOf)):
        if not any(takes.matches(x) and fits(x, first) for x in PROBES):
            raise ToolDefinitionError(f"no value of type {takes} suits the annotation {first!r}")
    return ToolContract(parameters=tuple(found), **given)


def tool(
    name: str | None = None,
    *,
    target: str = "value",
    input: Contract = JsonType.ANY,
    output: Contract = JsonType.ANY,
    api_version: int = API_VERSION,
    cardinality: str = "one_to_one",
    deterministic: bool = True,
    description: str = "",
    examples: list[Example] | tuple[Example, ...] = (),
) -> Callable[[Callable], Callable]:
    """Attaches a contract to a function and returns the function as it is."""

    def attach(fn: Callable) -> Callable:
        fn.__tool_contract__ = make_contract(
            fn, name=name or fn.__name__, target=target, input=input, output=output, api_version=api_version,
            cardinality=cardinality, deterministic=deterministic, description=description, examples=tuple(examples),
        )
        return fn

    return attach


def contract_of(fn: Callable) -> ToolContract:
    return fn.__tool_contract__
