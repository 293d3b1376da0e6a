import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordmill.llm import rules
from recordmill.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: tuple(r[c] for c in rules.STATS) for r in rules.text_stats(docs, ["doc_id"]).collect()}
    assert got == want


def test_odd_texts(odd):
    got = rules.text_stats(odd, ["doc_id", "text"]).collect()
    assert len(got) == 11
    for r in got:
        assert tuple(r[c] for c in rules.STATS) == brute(r.text)


def test_a_planted_rule_is_learned_and_clean_documents_stay(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(30)) + (" ###" * 9 if k % 3 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in rules.filter_documents(docs, labels).collect()}
    assert kept == {k for k in range(300) if k % 3}


def test_no_labels_and_nothing(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.filter_documents(odd, none).columns == odd.columns
    assert rules.filter_documents(nothing, none).count() == 0


def features(r):
    n, chars, lines = max(r.n_words, 1), max(r.word_chars, 1), max(r.n_lines, 1)
    return {
        "words": r.n_words, "mean_word_chars": r.word_chars / n, "symbols_per_word": r.n_symbols / n, "dup_line_share": r.n_dup_lines / lines, "repeat_share": r.n_repeat_words / n,
        "upper_share": r.n_upper / chars, "bangs_per_word": r.n_bangs / n, "distinct_share": r.n_distinct_words / n, "words_per_line": r.n_words / lines,
    }


def brute_rules(rows, max_rules=8, max_tests=3, bins=32, precision=0.97, least=5):
    """Sequential covering by trying every cut on every row. ``rows``: (features, bad, grow)."""
    cuts = {}
    for f in rows[0][0]:
        values = sorted(float(x[f]) for x, _, _ in rows)
        marks = sorted({values[max(0, math.ceil(k / bins * len(values)) - 1)] for k in range(bins + 1)})
        cuts[f] = [(a + b) / 2 for a, b in zip(marks, marks[1:])]
    holds = lambda x, t: (x[t[0]] > t[2]) == t[1]
    out, left = [], rows
    while len(out) < max_rules:
        tests = []
        while len(tests) < max_tests:
            part = [(x, bad) for x, bad, grow in left if grow and all(holds(x, t) for t in tests)]
            p0, n0 = sum(b for _, b in part), sum(not b for _, b in part)
            best = None
            for f in cuts if p0 and n0 else ():
                for cut in cuts[f]:
                    for above in (False, True):
                        hit = [b for x, b in part if holds(x, (f, above, cut))]
                        p, n = sum(hit), len(hit) - sum(hit)
                        if p >= least and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > (best[0] if best else 1e-9):
                            best = (gain, (f, above, cut), n)
            if best is None:
                break
            tests.append(best[1])
            if best[2] == 0:
                break
        worth = []
        for k in range(1, len(tests) + 1):
            count = lambda grow, bad: sum(g == grow and b == bad and all(holds(x, t) for t in tests[:k]) for x, b, g in left)
            gp, gn, p, n = count(True, True), count(True, False), count(False, True), count(False, False)
            if p + n and gp >= least and gp >= precision * (gp + gn) and p >= precision * (p + n):
                worth.append(((p - n) / (p + n), -k))
        if not worth:
            return out
        tests = tests[: -max(worth)[1]]
        out.append(tests)
        left = [r for r in left if not all(holds(r[0], t) for t in tests)]
    return out


def test_learning_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = table(rules.text_stats(docs, ["doc_id"]))
    learned = rules.learn(stats, labels)
    fold = (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) != 0).alias("grow")
    rows = stats.where(~rules.base_failed()).join(labels, "doc_id").select(*stats.columns, (F.col("quality") < 1).alias("bad"), fold).collect()
    want = brute_rules([(features(r), r.bad, r.grow) for r in rows])
    assert learned and [[(t.feature, t.above) for t in r] for r in learned] == [[t[:2] for t in r] for r in want]
    assert all(abs(a.threshold - b[2]) < 1e-9 for r, w in zip(learned, want) for a, b in zip(r, w))
    fired = {r.doc_id: r.rule for r in rules.judged(stats, learned).collect()}
    holds = lambda x, t: (x[t[0]] > t[2]) == t[1]
    for r in stats.collect():
        x = features(r)
        assert fired[r.doc_id] == next((k for k, tests in enumerate(want, 1) if all(holds(x, t) for t in tests)), 0)


@pytest.mark.parametrize("bad", [0, 1])
def test_one_class_gives_no_rule(spark, bad):
    stats = rules.text_stats(spark.createDataFrame([(k, "word " * 20) for k in range(9)], "doc_id long, text string"), ["doc_id"])
    labels = spark.createDataFrame([(k, bad, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    assert rules.learn(stats, labels) == []
