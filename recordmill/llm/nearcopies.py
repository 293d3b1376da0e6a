"""Near copies by Jaccard similarity of five-word shingles: SimHash BK-trees and MinHash give candidates, each checked exactly.

1. Each text becomes the set of its hashed shingles (A-Z in lower case). Texts of equal sets are one.
2. Each set has a SimHash fingerprint. ``bktree`` joins fingerprints within two bits by BK-trees; their sets, and sets of
   one fingerprint and its first, are candidates. Sets of similarity 0.8 differ in about ten bits, which no radius that
   can be sharded reaches, so pairs beyond it come from step 3.
3. ``BANDS`` hashes of ``ROWS`` MinHash values each place a set in buckets. Two sets of similarity s share a
   bucket with probability 1 - (1 - s^5)^24: 0.99993 at 0.8, more above.
4. The sets of candidates and of buckets with more than one member are compared in full, and a pair links at ``SIMILAR``.
   All members are held against their bucket's first; then, in buckets that links do not join, against the next
   3, 64, 1024, ... No pair of a bucket is left out but those that links have joined by then. Pairs are not rows:
   a task holds a tile of ``TILE`` sets of a bucket and streams up to ``STREAM`` others past it, so a large bucket
   is many tasks, each of bounded memory.
5. Linked sets are one group, and the smallest doc_id of a group stays.

Defined results: a null text counts as empty, and empty texts are copies of each other; repeated rows of the id
that stays are reduced to one; a row without a doc_id makes no links, and stays once if no row with an id has
its set; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from recordmill.llm import bktree
from recordmill.llm.common import components, lookup, lower_bytes, table

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
TILE, STREAM = 512, 8192
#: Members of a bucket that one task ranks, about.
DEALT = 1024
SEED = 43
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES, _PLUS = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle."""
    words = lower_bytes(text).split()
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return np.unique(np.fromiter((digest(join(words[k : k + SHINGLE]), SEED) for k in range(n)), np.uint64, n))


def bands(found: np.ndarray) -> list[int]:
    """A bucket for each band, as signed longs."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1))
    raw = least.tobytes()
    size = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` and ``fp`` (of the set) and ``bands`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, prints, keys = [], [], []
            for t in b.column(1):
                found = shingles(t.as_py())
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(bktree.simhash(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "fp", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, digest binary, fp long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``rep`` and ``set`` of the documents of ``ids(rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["rep", "set"])

    # A merge join at every size; the rows of an id are together after it, and dropDuplicates shuffles nothing.
    wanted = _texts(docs).join(ids.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return wanted.dropDuplicates().mapInArrow(run, "rep long, set array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that reach SIMILAR."""
    left, right = (sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    m, n = F.size("set_a"), F.size("set_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where((F.least(m, n) / F.greatest(m, n) >= SIMILAR) & (shared / (m + n - shared) >= SIMILAR)).select("a", "b").distinct()


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the tiles ``(key, chunk, salt, member, rep, root, set)``, sorted by tile and the tile's own sets first.

    A link whose two sides are joined by then, by their roots or by links of the tile, is left out.
    """
    now, up = None, {}
    held: list[tuple[int, int, np.ndarray]] = []
    words = first = owner = sizes = None

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for b in batches:
        found = []
        offsets, flat = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy(zero_copy_only=False)
        for k, (key, chunk, salt, member, rep, root) in enumerate(zip(*(c.to_pylist() for c in b.columns[:6]))):
            shingle = flat[offsets[k] : offsets[k + 1]]
            if (key, chunk, salt) != now:
                now, up, held, words = (key, chunk, salt), {}, [], None
            if not member:
                held.append((rep, root, shingle))
                continue
            if not held or not len(shingle):
                continue
            if words is None:  # the tile is whole: each shingle with the sets that have it
                sizes = np.array([len(x) for _, _, x in held])
                every, of = np.concatenate([x for _, _, x in held]), np.repeat(np.arange(len(held)), sizes)
                order = np.argsort(every, kind="stable")
                words, first = np.unique(every[order], return_index=True)
                first, owner = np.append(first, len(every)), of[order]
            at = np.minimum(np.searchsorted(words, shingle), len(words) - 1)
            at = at[words[at] == shingle]
            n = first[at + 1] - first[at]
            into = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[into], minlength=len(held))
            for j in np.flatnonzero(shared / (sizes + len(shingle) - shared) >= SIMILAR).tolist():
                other, other_root, _ = held[j]
                if other != rep and (x := top(root)) != (y := top(other_root)):
                    up[x] = y
                    found.append((other, rep))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])


def _tiled(rest: DataFrame, sets: DataFrame, low: int, high: int) -> DataFrame:
    """Links between the sets of ranks ``low + 1`` to ``high`` of each bucket and those of later ranks."""
    rows = rest.withColumns({"salts": F.ceil(F.col("n") / STREAM), "chunks": F.ceil((F.least(F.col("n"), F.lit(high)) - low) / TILE)})
    own = rows.where((F.col("rank") > low) & (F.col("rank") <= high)).withColumns({"chunk": F.floor((F.col("rank") - low - 1) / TILE), "salt": F.explode(F.expr("sequence(0L, salts - 1)")), "member": F.lit(False)})
    # A set of rank r is held against the chunks that begin below it.
    below = F.least(F.col("chunks"), F.ceil((F.col("rank") - low - 1) / TILE))
    others = rows.where(F.col("rank") > low + 1).withColumn("below", below).withColumns({"chunk": F.explode(F.expr("sequence(0L, below - 1)")), "salt": F.pmod(F.xxhash64("rep"), F.col("salts")), "member": F.lit(True)})
    columns = ["key", "chunk", "salt", "member", "rep", "root"]
    tiles = own.select(columns).unionAll(others.select(columns)).join(sets.hint("merge"), "rep").select(*columns, "set")
    dealt = tiles.repartition("key", "chunk", "salt").sortWithinPartitions("key", "chunk", "salt", "member")
    return dealt.mapInArrow(_tile_links, "a long, b long").distinct()


def _ranked(rest: DataFrame, members: DataFrame) -> DataFrame:
    """``rest(key, rep, root, n)`` with each member's ``rank`` in its bucket, from 1.

    Members are dealt to parts of their bucket by a hash, ranked in their part, and moved by the sizes of the parts before.
    ``rest`` has all members of a bucket that ``members`` has, or none.
    """
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / DEALT)).alias("part")
    sizes = members.where(F.col("n") > DEALT).select("key", part).groupBy("key", "part").count()
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "part", F.sum("count").over(before).alias("before"))
    # Spark takes rows dealt by key as dealt by (key, part) too, so the deal is stated.
    dealt = rest.select("*", part).join(sizes, ["key", "part"], "left").repartition("key", "part")
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("rep"))
    return dealt.select("key", "rep", "n", "root", (F.coalesce("before", F.lit(0)) + within).alias("rank"))


def near_prints(reps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``reps(rep, fp)`` that BK-trees of their fingerprints propose, ``a`` the smaller."""
    prints = table(reps.groupBy("fp").agg(F.min("rep").alias("first")))
    near = bktree.links(prints.select("fp", F.col("first").alias("rep")))
    same = lookup(reps.select("fp", "rep"), prints, ["fp"]).where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(same).distinct()


def joined_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(node, root)`` of the ids of ``reps(rep, fp, bands)`` that some similar set joins; root is the smallest of a group."""
    near = table(near_prints(reps))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n")).where("first < last")
    members = table(keys.join(table(shared.select("key", "first", "n")), "key"))
    ids = members.select("rep").unionAll(near.select("a")).unionAll(near.select("b")).distinct()
    sets = table(_sets(docs, ids))
    firsts = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    found = table(_similar(firsts.unionAll(near).distinct(), sets))
    # Buckets of three and more, while links leave them in parts.
    rest, low, joined = members.where("n > 2").select("key", "rep", "n"), 0, components(found)
    for high in itertools.chain((3, 64), (64 * 16**k for k in itertools.count(1))):
        rest = rest.join(joined, rest["rep"] == joined["node"], "left").select(*rest.columns, F.coalesce("root", "rep").alias("root"))
        parted = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        rest = rest.join(parted, "key", "left_semi")
        if not low:
            rest = _ranked(rest, members)
        rest = table(rest)
        if rest.where(F.col("rank") > low + 1).isEmpty():
            return joined
        found = table(_tiled(rest, sets, low, high))
        if not found.isEmpty():
            joined = components(joined.toDF("a", "b").unionAll(found))
        rest, low = rest.drop("root"), high


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` and ``component_id`` (the smallest doc_id of its group) of each row."""
    rows = table(signed(docs))
    distinct = table(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    joined = joined_sets(docs, distinct.where("rep is not null"))
    reps = distinct.join(joined, distinct["rep"] == joined["node"], "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    return lookup(rows, reps, ["digest"]).select("doc_id", "digest", "component_id")


def _with_digest(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [xxhash.xxh3_128_digest(shingles(t.as_py()).tobytes()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], [*b.schema.names[:-1], "_digest"])

    schema = StructType([*docs.schema.fields]).add("_digest", BinaryType())
    return docs.withColumn("_digest", F.col("text").cast("string")).mapInArrow(run, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: its smallest doc_id; rows without ids as the module says."""
    groups = table(grouped(docs.select("doc_id", "text")))
    kept = bktree.first_of_each(docs, groups.where("doc_id is not null"))
    if groups.where("doc_id is null").isEmpty():
        return kept
    known = groups.where("doc_id is not null").select(F.col("digest").alias("_digest")).distinct()
    loose = _with_digest(docs.where(F.col("doc_id").cast("long").isNull())).dropDuplicates(["_digest"])
    return kept.unionAll(loose.join(known, "_digest", "left_anti").select(*docs.columns))
