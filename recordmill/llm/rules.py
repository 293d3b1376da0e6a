"""Quality rules: a decision list learned by sequential covering, as Spark conditional expressions.

``text_stats`` measures every text with built-in functions. ``learn`` grows conjunctions of
thresholds on two thirds of the labelled rows by FOIL gain, prunes each on the other third,
and takes its rows away before the next one is grown. ``verdict`` turns the rules into one
ordered CASE expression. Nothing here runs Python on the executors.

Defined results: a null text counts as empty; a row without a label only gets a verdict; several
labels of a document count by their mean; windows are compared by 64-bit hashes; with no labels, or none of a class, no rule is learned
and only the base test decides; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import table, words_of

WINDOW = 5
CUT_ROWS = 10_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_bangs", "n_distinct_words", "n_lines")
#: What rules may test; all are cheap functions of the statistics.
FEATURES = {
    "words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def text_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and STATS and EXTRA (all long) of each row's whole ``text``."""
    body = F.coalesce(F.col("text"), F.lit(""))

    def without(chars: str) -> Column:
        return F.char_length(F.regexp_replace(body, chars, ""))

    step = df.select(
        *keep,
        words_of(F.col("text")).alias("_w"),
        F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_l"),
        F.char_length(body).alias("_n"),
        without(r"[#*$%&|<>]+").alias("_s"),
        without(r"[A-Z]+").alias("_u"),
        without(r"!+").alias("_b"),
    )
    gram = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    step = step.withColumn(
        "_g",
        F.expr(f"if(size(_w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({gram})))"),
    )
    # Only texts in which a window comes again are sorted: (window, place) by window.
    step = step.withColumn(
        "_o",
        F.expr(
            "if(size(array_distinct(_g)) = size(_g), cast(array() as array<struct<g: bigint, i: int>>), sort_array(transform(_g, (g, i) -> named_struct('g', g, 'i', i))))"
        ),
    )
    step = step.withColumn(
        "_p",
        F.expr("sort_array(transform(filter(_o, (x, k) -> coalesce(get(_o, k - 1).g = x.g, false) or coalesce(get(_o, k + 1).g = x.g, false)), x -> x.i))"),
    )
    return step.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.col("_n") - F.col("_s")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"aggregate(transform(_p, (x, k) -> least({WINDOW}, coalesce(get(_p, k + 1) - x, {WINDOW}))), 0L, (a, v) -> a + v)").alias("n_repeat_words"),
        (F.col("_n") - F.col("_u")).cast("long").alias("n_upper"),
        (F.col("_n") - F.col("_b")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``feature`` above (or at most) ``threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def conjunction(tests: list[Test] | tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def learn(
    stats: DataFrame,
    labels: DataFrame,
    *,
    max_rules: int = 8,
    max_tests: int = 3,
    bins: int = 32,
    min_precision: float = 0.97,
    min_covered: int = 5,
) -> list[tuple[Test, ...]]:
    """The rules that reject rows, in order, learned from ``labels(doc_id, quality)``.

    ``stats`` should be a table: filters on statistics that are still to be computed repeat the work.

    The driver gets at most ``len(FEATURES) * (bins + 1)`` counts a step. Thresholds lie between quantiles of at
    most ``CUT_ROWS`` labelled rows; counts are of all. A rule stays if its
    precision on the pruning third and on the growing part is ``min_precision`` or more.
    """
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rows = table(
        stats.where(~base_failed())
        .join(truth, "doc_id")
        .select("doc_id", *STATS, *EXTRA, "bad", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) != 0).alias("grow"))
    )
    names = list(FEATURES)
    # Cuts are quantiles of CUT_ROWS labelled rows at most, those of the smallest hashes: few enough to be exact, and the same each time.
    some = rows.orderBy(F.xxhash64(F.lit("cuts"), "doc_id"), "doc_id", *STATS, *EXTRA).limit(CUT_ROWS)
    cuts_row = some.agg(*[F.percentile_approx(F.expr(FEATURES[f]).cast("double"), [k / bins for k in range(bins + 1)], 10000).alias(f) for f in names]).first()
    cuts = {f: _midpoints(sorted(set(cuts_row[f] or []))) for f in names}
    binned = {f: _bin(FEATURES[f], cuts[f]) for f in names}

    rules: list[tuple[Test, ...]] = []
    left = rows
    while len(rules) < max_rules:
        tests: list[Test] = []
        before = None
        while len(tests) < max_tests:
            part = left.where(F.col("grow") & conjunction(tests))
            pairs = part.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), binned[f].alias("b")) for f in names])).alias("x"), "bad")
            counts = pairs.groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = _best_test(counts, cuts, min_covered)
            if best is None or best[0] <= 1e-9:
                break
            before = best[2]
            tests.append(best[1])
            if before[1] == 0:
                break
        if not tests:
            break
        tests = _pruned(left, tests, min_precision, min_covered)
        if not tests:
            break
        rules.append(tuple(tests))
        left = left.where(~conjunction(tests))
    return rules


def _midpoints(values: list[float]) -> list[float]:
    """Thresholds halfway between quantiles, so that a rule keeps its distance from either side."""
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _bin(value: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.lit(cuts), lambda c: F.expr(value) > c)) if cuts else F.lit(0)


def _best_test(counts: list, cuts: dict[str, list[float]], least: int) -> tuple[float, Test, tuple[int, int]] | None:
    """The test of the greatest FOIL gain; ties go to the first feature, cut and direction."""
    found = None
    for f, edges in cuts.items():
        by = {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == f}
        p0, n0 = sum(v[0] for v in by.values()), sum(v[1] for v in by.values())
        if not p0 or not n0:
            continue
        p = n = 0
        for k, cut in enumerate(edges):  # bin k: values above k cuts, so at most cut k
            p, n = p + by.get(k, (0, 0))[0], n + by.get(k, (0, 0))[1]
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                if p1 < least:
                    continue
                gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                if found is None or gain > found[0]:
                    found = (gain, Test(f, above, float(cut)), (p1, n1))
    return found


def _pruned(left: DataFrame, tests: list[Test], precision: float, least: int) -> list[Test]:
    """The prefix that does best on the pruning rows, or nothing if it isn't precise enough."""
    sums = []
    for k in range(1, len(tests) + 1):
        hit = conjunction(tests[:k])
        for grow in (True, False):
            for bad in (True, False):
                sums.append(F.count_if(hit & (F.col("grow") == grow) & (F.col("bad") == bad)).alias(f"{k}{int(grow)}{int(bad)}"))
    got = left.agg(*sums).first()
    best = None
    for k in range(1, len(tests) + 1):
        gp, gn, p, n = got[f"{k}11"], got[f"{k}10"], got[f"{k}01"], got[f"{k}00"]
        if p + n == 0 or gp < least or gp < precision * (gp + gn) or p < precision * (p + n):
            continue
        worth = (p - n) / (p + n)
        if best is None or worth > best[0]:
            best = (worth, k)
    return tests[: best[1]] if best else []


def fired(rules: list[tuple[Test, ...]]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(conjunction(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def judged(stats: DataFrame, rules: list[tuple[Test, ...]]) -> DataFrame:
    """``stats`` with ``base_failed``, ``kept`` and the number of the ``rule`` that rejected."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", fired(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the base test or a learned rule rejects; same columns and rows.

    Texts are measured once: rows and statistics are written together, learning reads the statistics' columns
    only, and judging reads all. No text is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    seen = table(text_stats(docs.select(row, "text"), ["_row"]))
    rules = learn(seen.withColumn("doc_id", F.col("_row.doc_id")), labels)
    return judged(seen, rules).where("kept").select("_row.*")
