"""SimHash near-duplicates by BK-trees over sharded fingerprints.

Every distinct fingerprint goes to six shards, one for each pair of its four 16-bit blocks: two
fingerprints of at most two differing bits agree on some pair. A shard's BK-tree, whose children
are keyed by their Hamming distance to the parent, is built in the task that owns the shard, and
a search follows only edges within the radius. The trees are not broadcast: together they grow
with the corpus and no size bound holds for them. Shards of over ``SHARD`` fingerprints are split
by further bits (three parts, one of which must agree), up to twice; as fingerprints are distinct,
14 or 15 free bits are left then, so a shard has 32,768 fingerprints at the very most.

Defined results: a null text counts as empty and has fingerprint zero; repeated rows each get
their row; a row without a doc_id gets the component of its fingerprint, null if no row with an
id has that fingerprint, and makes no links; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import components, lookup, lower_bytes, table

RADIUS = 2
SHINGLE = 3
SEED = 42
SHARD = 512


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: bit k is set if it is set in over half of the shingles' hashes."""
    words = lower_bytes(text).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    n = len(words) - SHINGLE + 1
    return simhash(np.fromiter((digest(join(x), SEED) for x in zip(words, words[1:], words[2:])), np.uint64, n))


def simhash(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([_signed(fingerprint(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers by Hamming distance; a node is ``[value, {distance: child}]``."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            x, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(x)
            for k in range(max(1, d - radius), d + radius + 1):
                if k in children:
                    todo.append(children[k])
        return found


def _levels() -> list[list[tuple[int, int, int]]]:
    """By level, (id, mask, id of the mask it splits): six pairs of blocks, then thirds of the free bits."""

    def split(bits: list[int], n: int) -> list[list[int]]:
        return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]

    blocks = split(list(range(64)), 4)
    level = [(k, x, -1) for k, x in enumerate(blocks[i] + blocks[j] for i in range(4) for j in range(i + 1, 4))]
    out = []
    for _ in range(3):
        out.append([(k, sum(1 << b for b in bits), above) for k, bits, above in level])
        first = level[-1][0] + 1
        parts = [(bits + third, k) for k, bits, _ in level for third in split([b for b in range(64) if b not in bits], 3)]
        level = [(first + j, bits, above) for j, (bits, above) in enumerate(parts)]
    return out


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join what a shard's earlier links have not joined; rows come sorted by shard."""

    def links(members: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        tree, ids, up = BKTree(), dict(members), {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for fp, _ in members:
            for other in tree.within(fp, RADIUS):
                if (a := top(fp)) != (b := top(other)):
                    up[a] = b
                    yield ids[fp], ids[other]
            tree.add(fp)

    def shards() -> Iterator[list[tuple[int, int]]]:
        now, members = None, []
        for b in batches:
            for m, key, fp, rep in zip(*(c.to_pylist() for c in b.columns)):
                if (m, key) != now:
                    yield members
                    now, members = (m, key), []
                members.append((fp & (2**64 - 1), rep))
        yield members

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    found: list[tuple[int, int]] = []
    for members in shards():
        if len(members) > 1:
            found.extend(links(members))
        if len(found) >= 50_000:
            yield batch(found)
            found = []
    yield batch(found)


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the representatives of ``prints(fp, rep)``; enough to join all that link."""
    todo, found, levels = prints.withColumn("m", F.lit(-1)), [], _levels()
    for level in levels:
        shards = F.array(
            *[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"), F.lit(above).alias("above")) for i, mask, above in level]
        )
        own = F.filter(shards, lambda x: x["above"] == F.col("m"))
        rows = todo.select("fp", "rep", F.explode(own).alias("x")).select("x.m", "x.key", "fp", "rep")
        sizes = table(rows.groupBy("m", "key").count().where("count > 1"))
        split = level is not levels[-1]
        whole = sizes.where(F.col("count") <= SHARD) if split else sizes
        dealt = rows.join(whole, ["m", "key"], "left_semi").repartition("m", "key").sortWithinPartitions("m", "key", "fp")
        found.append(dealt.select("m", "key", "fp", "rep").mapInArrow(_shard_links, "a long, b long"))
        large = sizes.where(F.col("count") > SHARD)
        if not split or large.isEmpty():
            break
        todo = table(rows.join(large, ["m", "key"], "left_semi").select("fp", "rep", "m"))
    return reduce(DataFrame.unionAll, found)


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest doc_id that links reach) of each row."""
    rows = table(fingerprints(docs))
    distinct = table(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(distinct.where("rep is not null")))
    reps = distinct.join(joined, distinct["rep"] == joined["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return lookup(rows, reps, ["fp"]).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id; without ids, one row of a fingerprint."""
    return first_of_each(docs, grouped(docs.select("doc_id", "text")))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id of its group in ``groups(doc_id, component_id)``.

    Repeated rows of the id that stays are reduced to one. The ids that stay are most of all ids, so the join
    with them is a sort-merge join at every size; a broadcast of them would grow with the corpus.
    """
    ids = table(groups.where("doc_id <=> component_id").groupBy("doc_id").count())
    n = ids.count()
    once, often = table(ids.where("count = 1"), n), ids.where("count > 1")
    key = F.col("doc_id").cast("long")

    def among(which: DataFrame) -> DataFrame:
        which = which.select(F.col("doc_id").alias("_kept_id"))
        return docs.join(which.hint("merge"), key.eqNullSafe(which["_kept_id"]), "left_semi")

    if often.isEmpty():
        return among(once)
    return among(once).unionAll(among(often).dropDuplicates(["doc_id"]))
