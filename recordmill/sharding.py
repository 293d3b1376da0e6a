"""Which records a rank owns, as conditions on DataFrames and as plain functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.errors import ShardingError
from recordmill.model import RuntimeContext


class Sharding:
    """``owns`` for one record; ``column`` for a DataFrame with ``seq``, or None if only ``owns`` can tell."""

    def owns(self, seq: int, value: Any, rank: int, world: int) -> bool:
        raise NotImplementedError

    def column(self, rank: int, world: int, total: int | None) -> Column | None:
        return None

    def position(self, rank: int, world: int, total: int | None) -> Column | None:
        """The place of a record among those of its rank, if its number tells it."""
        return None


class NoSharding(Sharding):
    """Rank 0 has all."""

    def owns(self, seq: int, value: Any, rank: int, world: int) -> bool:
        return rank == 0

    def column(self, rank: int, world: int, total: int | None) -> Column:
        return F.lit(rank == 0)

    def position(self, rank: int, world: int, total: int | None) -> Column:
        return F.col("seq")


class ModuloSharding(Sharding):
    def owns(self, seq: int, value: Any, rank: int, world: int) -> bool:
        return seq % world == rank

    def column(self, rank: int, world: int, total: int | None) -> Column:
        return F.pmod(F.col("seq"), F.lit(world)) == rank

    def position(self, rank: int, world: int, total: int | None) -> Column:
        return F.floor(F.col("seq") / world)


class HashSharding(Sharding):
    """By the first eight bytes of a key's SHA-256. ``key`` is a function of the value, or a Column."""

    def __init__(self, key: Callable[[Any], Any] | Column | None = None, hash_fn: Callable[[Any], int] | None = None) -> None:
        self.key, self.hash_fn = key, hash_fn

    def owns(self, seq: int, value: Any, rank: int, world: int) -> bool:
        key = self.key(value) if callable(self.key) else value
        if self.hash_fn:
            return self.hash_fn(key) % world == rank
        data = key if isinstance(key, bytes) else (key if isinstance(key, str) else repr(key)).encode()
        return int.from_bytes(hashlib.sha256(data).digest()[:8], "big") % world == rank

    def column(self, rank: int, world: int, total: int | None) -> Column | None:
        if not isinstance(self.key, Column) or self.hash_fn:
            return None
        return hashed_shard(self.key, world) == rank


def hashed_shard(key: Column, world: int) -> Column:
    """The rank that owns a key's text, without Python."""
    first = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(first, F.lit(world)).cast("int")


class RangeSharding(Sharding):
    """Neighbouring records, the first ranks one more if the total doesn't divide."""

    def __init__(self, total: int | None = None) -> None:
        self.total = total

    def bounds(self, rank: int, world: int, total: int | None = None) -> tuple[int, int]:
        n = self.total if self.total is not None else total
        if n is None or n <= 0:
            raise ShardingError("a range needs the number of records, and the source doesn't know it")
        each, more = divmod(n, world)
        first = rank * each + min(rank, more)
        return first, first + each + (rank < more)

    def owns(self, seq: int, value: Any, rank: int, world: int) -> bool:
        a, b = self.bounds(rank, world)
        return a <= seq < b

    def column(self, rank: int, world: int, total: int | None) -> Column:
        a, b = self.bounds(rank, world, total)
        return (F.col("seq") >= a) & (F.col("seq") < b)

    def position(self, rank: int, world: int, total: int | None) -> Column:
        return F.col("seq") - self.bounds(rank, world, total)[0]


def default_sharding_for(runtime: RuntimeContext) -> Sharding:
    return NoSharding() if runtime.world_size == 1 else ModuloSharding()
