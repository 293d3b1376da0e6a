"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

``scan`` finds the base spans and the candidates: runs of 16 or more characters of ``ALPHABET``, a letter among them. Two
bigram models are trained from labelled samples, one of random strings and one of identifiers; a
candidate's score is the mean log-likelihood ratio of its bigrams, and it becomes a ``markov`` span if
the score is above ``THRESHOLD`` and no base span holds it. Only built-in functions run on executors.

Labelled samples: random are the values that the base patterns find and a fixed number of generated
digests in three alphabets; identifiers are the candidates that lie in no base span and have letters
only. Counts cover all documents.

Places count code points; ends are exclusive. Defined results: a null text counts as empty; without
identifiers their model is uniform; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import let, running, table

# The base kinds in order, their patterns, the group that is measured and its least length.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: The same matches, but for those that fail by their length: no shorter run can hold a longer one.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
THRESHOLD = 0.5
GENERATED = 2000
BACKOFF = 5.0


def _matches(pattern: str, group: int) -> Column:
    """Array of (s, e, t): where each match of ``_text`` begins and ends, and the group's text. JVM only.

    The text between matches comes from split, the matches from regexp_extract_all; running sums of lengths give places.
    """
    gaps = F.transform(F.split("_text", pattern, -1), lambda x: F.char_length(x))
    hits = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    texts = hits if group == 0 else F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), texts.alias("t")), lambda x: x["hit"].isNotNull())
    parts = F.transform(zipped, lambda x: F.struct(F.char_length(x["hit"]).alias("len"), x["gap"].alias("gap"), x["t"].alias("t")))

    def spans(b: Column) -> Column:
        ends = running(F.transform(b, lambda x: x["gap"] + x["len"]), 0, lambda a, x: a + x)
        return F.transform(F.arrays_zip(b.alias("x"), ends.alias("e")), lambda z: F.struct((z["e"] - z["x"]["len"]).alias("s"), z["e"].alias("e"), z["x"]["t"].alias("t")))

    none = F.array().cast("array<struct<s: int, e: int, t: string>>")
    return F.when(F.col("_text").rlike(pattern), let(parts, spans)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` (array of s, r, e, t; r is the kind's number) and ``candidates`` (array of s, e, t; no base span holds them)."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    for k in KINDS:
        pattern, group, least = PATTERNS[k]
        rows = rows.withColumn(f"_{k}", _long(_matches(QUICK.get(k, pattern), group), least))
    rows = rows.withColumn("_found", F.filter(_matches(CANDIDATE, 0), lambda x: x["t"].rlike("[A-Za-z]")))
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[F.transform(f"_{k}", _ranked(r)) for r, k in enumerate(KINDS)])))
    return rows.select("doc_id", F.col("_base").alias("base"), _outside(F.col("_base"), F.col("_found")).alias("candidates"))


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.char_length(x["t"]) >= least)


def _ranked(r: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(r).alias("r"), x["e"].alias("e"), x["t"].alias("t"))


def _outside(base: Column, found: Column) -> Column:
    """The spans ``found`` that no base span holds: in the order of starts, no base span before one ends where it ends or later."""
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("c"), x["e"].alias("e"), x["t"].alias("t"))),
            F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("c"), x["e"].alias("e"), x["t"].alias("t"))),
        )
    )

    def free(b: Column) -> Column:
        upto = running(F.transform(b, lambda x: F.when(x["c"] == 0, x["e"]).otherwise(F.lit(0))), 0, lambda a, x: F.greatest(a, x))
        kept = F.filter(F.arrays_zip(b.alias("x"), upto.alias("upto")), lambda z: (z["x"]["c"] == 1) & (z["x"]["e"] > z["upto"]))
        return F.transform(kept, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["e"].alias("e"), z["x"]["t"].alias("t")))

    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(let(both, free))


def samples(scanned: DataFrame) -> DataFrame:
    """``token`` and ``random``: the labelled samples of the docstring above."""
    base = scanned.select(F.explode("base.t").alias("token"), F.lit(True).alias("random"))
    names = scanned.select(F.explode("candidates").alias("c")).select(F.col("c.t").alias("token")).where(F.col("token").rlike("^[A-Za-z]+$")).withColumn("random", F.lit(False))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    made = scanned.sparkSession.range(GENERATED).select(
        F.explode(F.array(F.substring(digest, 1, 16), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", ""))).alias("token"), F.lit(True).alias("random")
    )
    return base.unionAll(names).unionAll(made)


def _places(token: Column) -> Column:
    """Places of a token's characters in the alphabet, from 1; 0 for others."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(tokens: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over identifier) of all bigrams of the alphabet, row by row.

    The driver gets at most two counts for each bigram.
    """
    n = len(ALPHABET)
    chars = tokens.select("random", _places(F.col("token")).alias("p"))
    pairs = chars.select("random", F.explode(F.expr("if(size(p) < 2, cast(array() as array<int>), transform(sequence(0, size(p) - 2), i -> (p[i] - 1) * %d + p[i + 1] - 1))" % n)).alias("pair"))
    got = {(r["random"], r["pair"]): r["count"] for r in pairs.where(F.col("pair").between(0, n * n - 1)).groupBy("random", "pair").count().collect()}
    logs = {}
    for kind in (True, False):
        rows = [[got.get((kind, a * n + b), 0) for b in range(n)] for a in range(n)]
        whole = sum(map(sum, rows))
        # A bigram falls back on its second character, so that a first one never seen still says something.
        single = [(sum(row[b] for row in rows) + 0.5) / (whole + 0.5 * n) for b in range(n)]
        for a, row in enumerate(rows):
            total = sum(row)
            for b in range(n):
                logs[kind, a * n + b] = math.log((row[b] + BACKOFF * single[b]) / (total + BACKOFF))
    return [logs[True, k] - logs[False, k] for k in range(n * n)]


def _scored(ratios: list[float]) -> tuple[Column, Column]:
    """The ratios as a column, and the candidates outside base spans whose mean log-likelihood ratio is above the threshold."""
    n = len(ALPHABET)
    ratio = "array(" + ", ".join(f"{x:.6f}D" for x in ratios) + ")"
    score = (
        "aggregate(sequence(0, size(c.p) - 2), 0D, (a, i) -> a + if(c.p[i] > 0 and c.p[i + 1] > 0, _ratios[(c.p[i] - 1) * %d + c.p[i + 1] - 1], 0D)) / (size(c.p) - 1)" % n
    )
    return F.expr(ratio), F.expr(f"filter(_placed, c -> {score} > {THRESHOLD})")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans`` and ``n_markov`` of each row."""
    scanned = table(scan(docs))
    ratios, taken = _scored(train(samples(scanned)))
    rows = scanned.withColumn("_placed", F.transform("candidates", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), _places(c["t"]).alias("p"))))
    rows = rows.withColumn("_ratios", ratios).withColumn("_markov", taken)
    every = F.array_sort(
        F.concat(
            F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), x["e"].alias("e"))),
            F.transform("_markov", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("r"), x["e"].alias("e"))),
        )
    )
    names = F.lit([*KINDS, "markov"])

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["r"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")

    counts = [F.size(F.filter("base", _is(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    base = F.sha2(said(F.col("base")), 256)
    return rows.select("doc_id", *counts, base.alias("base_sha256"), said(every).alias("spans"), F.size("_markov").cast("long").alias("n_markov"))


def _is(r: int):
    return lambda x: x["r"] == r
