"""The JSON types of tool contracts."""

from __future__ import annotations

import math
from enum import Enum
from typing import Any


class JsonType(Enum):
    NULL = "null"
    BOOLEAN = "boolean"
    INTEGER = "integer"
    NUMBER = "number"
    STRING = "string"
    ARRAY = "array"
    OBJECT = "object"
    SCALAR = "scalar"
    CONTAINER = "container"
    ANY = "any"

    def matches(self, x: Any) -> bool:
        return _MATCH[self](x)

    def __str__(self) -> str:
        return self.value


def _number(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and math.isfinite(x)


def is_json(x: Any) -> bool:
    """Whether x is JSON all the way down: text keys, finite numbers."""
    todo = [x]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if not all(isinstance(k, str) for k in v):
                return False
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
        elif not (v is None or isinstance(v, (bool, str)) or _number(v)):
            return False
    return True


_MATCH = {
    JsonType.NULL: lambda x: x is None,
    JsonType.BOOLEAN: lambda x: isinstance(x, bool),
    JsonType.INTEGER: lambda x: isinstance(x, int) and not isinstance(x, bool),
    JsonType.NUMBER: _number,
    JsonType.STRING: lambda x: isinstance(x, str),
    JsonType.ARRAY: lambda x: isinstance(x, list),
    JsonType.OBJECT: lambda x: isinstance(x, dict),
    JsonType.SCALAR: lambda x: x is None or isinstance(x, (bool, str)) or _number(x),
    JsonType.CONTAINER: lambda x: isinstance(x, (list, dict)),
    JsonType.ANY: is_json,
}


class OneOf:
    """Any of two or more types; nested ones are taken apart."""

    def __init__(self, *members: JsonType | OneOf) -> None:
        flat: list[JsonType] = []
        for m in members:
            for t in m.members if isinstance(m, OneOf) else (m,):
                if not isinstance(t, JsonType):
                    raise TypeError(f"not a JSON type: {t!r}")
                if t not in flat:
                    flat.append(t)
        if len(flat) < 2:
            raise ValueError("OneOf takes two types or more")
        self.members = tuple(flat)

    def matches(self, x: Any) -> bool:
        return any(t.matches(x) for t in self.members)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, OneOf) and set(self.members) == set(other.members)

    def __hash__(self) -> int:
        return hash(frozenset(self.members))

    def __str__(self) -> str:
        return "|".join(str(t) for t in self.members)

    __repr__ = __str__


Contract = JsonType | OneOf
#: A value of each kind, by which two contracts are compared.
PROBES: tuple[Any, ...] = (None, True, 1, 1.5, "text", [], {})


def compatible(producer: Contract, consumer: Contract) -> bool:
    return any(producer.matches(x) and consumer.matches(x) for x in PROBES)


def type_name(x: Any) -> str:
    """The narrowest type of a value, or its Python class."""
    for t in (JsonType.NULL, JsonType.BOOLEAN, JsonType.INTEGER, JsonType.NUMBER, JsonType.STRING, JsonType.ARRAY, JsonType.OBJECT):
        if t.matches(x):
            return str(t)
    return type(x).__name__


def parse_type(text: str) -> Contract:
    parts = [JsonType(p) for p in text.split("|")]
    return OneOf(*parts) if len(parts) > 1 else parts[0]
