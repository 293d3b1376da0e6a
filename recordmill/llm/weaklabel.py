"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

For each task (quality, toxicity) several heuristics vote 1, -1 or 0 on a text. The counts of vote
patterns, a table of at most 3 to the number of labellers, go to the driver, where expectation-
maximisation estimates each labeller's accuracy without any truth. The posteriors of a bounded sample
(``SAMPLE`` texts, those of the smallest hashes, with ``FEATURES`` features together) train a logistic scorer over hashed words
and steps of the statistics; the scorer then scores every document, whole.

One toxicity labeller knows stems (words and beginnings of words) that ``labels(doc_id, toxic)`` show to be
toxic, so that it works in any language: at most ``STEMS`` of them, learned from at most ``LABELLED``
labelled documents, those of the smallest hashes of doc_id. Without labels it has no opinion.

The labellers of a task share no list of words, and an abstention from a vote on toxicity is no evidence, once there
are stems, so that the independence which the estimate assumes holds as far as the texts allow.

Defined results: a null or empty text is of low quality and not toxic by its votes and is scored like
any other; with no documents nothing is trained and nothing returned; repeated rows each get their
row, with or without an id; a document with several labels is toxic if one of them says so, and null labels say nothing; equal
texts count once; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import LOWER, table
from recordmill.llm.pii import estimate

BUCKETS = 1 << 18
SAMPLE, FEATURES = 20_000, 8_000_000
EPOCHS = 40
LABELLED = 20_000
STEMS = 5000
STEM_BYTES = range(4, 10)
STEM_PRECISION = 0.9
# Insults that the toxicity labellers look for, by severity.
HARSH = frozenset(b"idiot moron scum stupid trash".split())
MILD = frozenset(b"clown disgusting loser pathetic worthless".split())
# Frequent words of four languages.
COMMON = frozenset("the of and to in is that it was for la le de et les des un une que en der die und das ein von zu el los y por con se".encode().split())
QUALITY = ("length", "symbols", "capitals", "repeats", "shouts", "variety", "common", "tidy")
TOXIC = ("harsh", "mild", "stems")
SYMBOLS = re.compile(rb"[#*$%&|<>{}\\^~]")
EDGES = b".,;:!?\"'()[]"
SCORED = "doc_id long, quality_posterior double, quality_score double, toxic_posterior double, toxic_score double"


class Stems:
    """Words and beginnings of words; ``hits`` counts the words that are or begin with one."""

    def __init__(self, stems: frozenset[bytes] = frozenset()) -> None:
        self.stems = stems
        self.heads = frozenset(s[: STEM_BYTES[0]] for s in stems)

    def hits(self, kinds: set[bytes]) -> int:
        heads = self.heads
        return sum(not self.stems.isdisjoint(stems_of(w)) for w in kinds if w[: STEM_BYTES[0]] in heads)


def stems_of(word: bytes) -> list[bytes]:
    """The word and its beginnings; nothing for a short word."""
    return [word, *(word[:n] for n in STEM_BYTES if n < len(word))] if len(word) >= STEM_BYTES[0] else []


NO_STEMS = Stems()


def described(text: str | None, stems: Stems = NO_STEMS) -> tuple[list[int], list[int], list[bytes]]:
    """Votes on quality, votes on toxicity, and the scorer's features as words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    low = [w.strip(EDGES) for w in raw.translate(LOWER).split()]
    kinds = set(low)
    many = max(1, n)
    symbols = len(SYMBOLS.findall(raw)) / many
    letters = max(1, sum(map(len, words)))
    capitals = sum(map(raw.count, (bytes([c]) for c in range(65, 91)))) / letters
    variety = len(kinds) / many
    same = sum(a == b for a, b in zip(low, low[1:])) / many
    common = sum(map(low.count, COMMON & kinds)) / many
    shouts = raw.count(b"!") / many
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    # Defect labellers have no opinion on a text without their defect; the last three also speak for a text.
    quality = [
        -1 if n < 3 else 0,
        -1 if symbols > 0.1 else 0,
        -1 if capitals > 0.3 else 0,
        -1 if same > 0.1 or again > 0.3 else 0,
        -1 if shouts > 0.2 else 0,
        1 if variety > 0.4 else -1 if variety < 0.3 and n < 2000 else 0,
        1 if common > 0.08 else -1 if common < 0.02 and n >= 30 else 0,
        1 if n >= 3 and symbols < 0.02 and capitals < 0.15 and shouts < 0.05 and same < 0.05 else -1,
    ]
    # Two lists without a common word, and what is learned. A list of English words has no opinion on a text without them;
    # stems have, as they are learned in every language. One stem may be chance.
    stem = stems.hits(kinds)
    toxic = [1 if HARSH & kinds else 0, 1 if MILD & kinds else 0, 0 if not stems.stems else 1 if stem > 1 else -1]
    steps = (("n", min(n, 1000) // 10 if n < 30 else 99), ("sym", int(min(symbols, 1) * 20)), ("cap", int(capitals * 20)), ("var", int(min(variety, 1) * 10)), ("same", int(same * 20)), ("again", int(again * 10)), ("com", int(common * 25)), ("shout", int(min(shouts, 1) * 20)), ("stem", min(stem, 3)))
    return quality, toxic, [*kinds, *(f" {k}{v}".encode() for k, v in steps)]


def hashed(features: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(zlib.crc32, features), np.uint32, len(features)) & (BUCKETS - 1)).astype(np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sampled(keys: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``keys(doc_id, ...)``, those of the smallest hashes of doc_id."""
    return keys.where("doc_id is not null").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most)


def learned_stems(docs: DataFrame, labels: DataFrame) -> frozenset[bytes]:
    """Stems whose texts are toxic in ``STEM_PRECISION`` of the cases, more often than chance makes one of so many stems.

    The log-likelihood ratio against the share of all texts must pass the logarithm of the number of stems.
    The driver gets ``STEMS`` rows at most.
    """
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    truth = sampled(truth.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), LABELLED)
    rows = _texts(docs).join(F.broadcast(truth), "doc_id").where("text is not null")  # LABELLED rows at most
    rows = table(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    kinds = [("stem", pa.binary()), ("t", pa.int64()), ("c", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def batch() -> pa.RecordBatch:
            columns = [list(counts), *([n[k] for n in counts.values()] for k in (0, 1))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                low = text.as_py().encode("utf-8", "surrogatepass").translate(LOWER).split()
                for stem in {s for w in {w.strip(EDGES) for w in low} for s in stems_of(w)}:
                    counts.setdefault(stem, [0, 0])[0 if toxic > 0 else 1] += 1
                if len(counts) >= 300_000:
                    yield batch()
                    counts.clear()
        yield batch()

    counts = table(rows.mapInArrow(run, "stem binary, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    n, whole = counts.count(), rows.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count("*").alias("n")).first()
    if not whole["t"] or whole["t"] == whole["n"]:
        return frozenset()
    share = whole["t"] / whole["n"]
    clean = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (F.col("t") + F.col("c")) / (1 - share))).otherwise(0.0)
    ratio = F.col("t") * F.log(F.col("t") / (F.col("t") + F.col("c")) / share) + clean
    sure = counts.where(F.col("t") > 0).where(F.col("t") >= max(STEM_PRECISION, share) * (F.col("t") + F.col("c"))).withColumn("ratio", ratio)
    found = sure.where(F.col("ratio") > float(np.log(n))).orderBy(F.col("ratio").desc(), "stem").limit(STEMS).select("stem").collect()
    return frozenset(bytes(r["stem"]) for r in found)


def voted(docs: DataFrame, stems: Stems = NO_STEMS) -> DataFrame:
    """``doc_id``, ``q`` and ``t`` (arrays of votes) of each row."""
    kind = pa.list_(pa.int32())
    known = docs.sparkSession.sparkContext.broadcast(stems)  # at most STEMS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [described(t.as_py(), known.value)[:2] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], kind), pa.array([x[1] for x in got], kind)], ["doc_id", "q", "t"])

    return _texts(docs).mapInArrow(run, "doc_id long, q array<int>, t array<int>")


def posteriors(votes: DataFrame, column: str, silent: bool = False) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The posterior of each vote pattern, and each labeller's accuracy (of the votes it gives)."""
    rows = votes.groupBy(column).count().orderBy(column).collect()
    if not rows:
        return {}, np.zeros(0)
    patterns = np.array([r[column] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    tables, share, post = estimate(patterns, counts, silent=silent)
    right = share * tables[:, 1, 2] + (1 - share) * tables[:, 0, 0]
    said = share * (tables[:, 1, 2] + tables[:, 1, 0]) + (1 - share) * (tables[:, 0, 0] + tables[:, 0, 2])
    return {tuple(p): float(x) for p, x in zip(patterns.tolist(), post)}, right / said


def fit(features: list[np.ndarray], targets: np.ndarray, *, step: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights (BUCKETS, and the bias last) of a logistic scorer, by AdaGrad over the whole sample.

    A text's features share a weight of one: each counts 1 over the root of their number.
    """
    sizes = np.array([len(x) for x in features])
    flat = np.concatenate(features)
    scale = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    at = np.cumsum(sizes) - sizes
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[flat] * scale, at) + weights[-1], -50, 50)))
        off = (p - targets) / len(targets)
        grad = np.append(np.bincount(flat, np.repeat(off, sizes) * scale, BUCKETS), off.sum())
        grad[:-1] += decay * weights[:-1] / len(targets)
        seen += grad * grad
        weights -= step * grad / np.sqrt(seen)
    return weights


def score(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """SCORED of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    stems = NO_STEMS if labels is None else Stems(learned_stems(docs, labels))
    votes = table(voted(docs, stems))
    quality, _ = posteriors(votes, "q")
    toxic, _ = posteriors(votes, "t", silent=bool(stems.stems))  # stems have an opinion on every text
    if not quality:
        return spark.createDataFrame([], SCORED)
    # Equal texts count once. The digest of a text places it in the sample, so rows without an id count too.
    texts = _texts(docs).select("text", F.xxhash64(F.lit("sample"), F.coalesce("text", F.lit(""))).alias("h"))
    chosen = texts.select("h").distinct().orderBy("h").limit(SAMPLE)
    sample = texts.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    sent = spark.sparkContext.broadcast((quality, toxic, stems))  # at most 3 ** labellers patterns, and STEMS words

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [described(t.as_py(), sent.value[2]) for t in b.column(1)]
            y = [[sent.value[k][tuple(x[k])] for x in got] for k in (0, 1)]
            x = pa.array([hashed(x[2]) for x in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), x, pc.cast(pc.list_value_length(x), pa.int64()), pa.array(y[0]), pa.array(y[1])], ["h", "x", "size", "q", "t"])

    made = table(sample.mapInArrow(features, "h long, x array<int>, size long, q double, t double"))
    # SAMPLE rows at most, in the order of digests as long as they have FEATURES features together.
    upto = made.select("h", F.sum("size").over(Window.orderBy("h")).alias("upto")).where(F.col("upto") <= FEATURES)
    rows = made.join(F.broadcast(upto.select("h")), "h", "left_semi").orderBy("h").toArrow()
    if not rows.num_rows:
        return docs.sparkSession.createDataFrame([], SCORED)
    x = [np.asarray(v.values) for v in rows.column("x")]
    weights = np.stack([fit(x, rows.column(c).to_numpy()) for c in ("q", "t")], axis=1).astype(np.float32)
    model = spark.sparkContext.broadcast(weights)  # BUCKETS x 2 floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            out = []
            for t in b.column(1):
                q, v, words = described(t.as_py(), sent.value[2])
                at = hashed(words)
                z = w[at].sum(axis=0) / np.sqrt(max(1, len(at))) + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                out.append((sent.value[0][tuple(q)], float(p[0]), sent.value[1][tuple(v)], float(p[1])))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in columns)], [c.split()[0] for c in SCORED.split(", ")])

    return _texts(docs).mapInArrow(scored, SCORED)


def judged(docs: DataFrame, labels: DataFrame | None = None, *, quality: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """``score`` with ``toxic`` and ``kept``: good enough, and not toxic."""
    scored = score(docs, labels)
    return scored.withColumn("toxic", F.col("toxic_score") >= toxic).withColumn("kept", (F.col("quality_score") >= quality) & (F.col("toxic_score") < toxic))
