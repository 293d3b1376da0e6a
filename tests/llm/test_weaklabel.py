import math
import random
from collections import Counter

from pyspark.sql import functions as F

from recordmill.llm import weaklabel


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(2)) == 0
    rows = weaklabel.judged(docs, labels.where(~held)).join(labels.where(held).withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    good = [r for r in rows if r.quality and not r.is_toxic]
    bad = [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    clean = [r for r in rows if not r.is_toxic]
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)


def toxic_texts(seed, n):
    """Texts of invented words; a fifth are toxic, with three words that begin with an invented stem."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "to", "mi", "re", "su", "lan", "che"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for k in range(n):
        w = [word() for _ in range(60)]
        if k % 5 == 0:
            w[10:40:10] = [rng.choice(["zorgu", "vexil"]) + word() for _ in range(3)]
        rows.append((k, " ".join(w), k % 5 == 0))
    return rows


def brute_stems(rows):
    toxic, clean = Counter(), Counter()
    for text, bad in rows.items():
        stems = {s for w in text.encode().split() for s in weaklabel.stems_of(w)}
        (toxic if bad else clean).update(stems)
    share, n = sum(rows.values()) / len(rows), len(set(toxic) | set(clean))
    out = set()
    for s, t in toxic.items():
        c = clean[s]
        ratio = t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0)
        if t >= weaklabel.STEM_PRECISION * (t + c) and ratio > math.log(n):
            out.add(s)
    return out


def test_stems_equal_brute_force(spark):
    rows = toxic_texts(1, 400)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(x)) for k, _, x in rows], "doc_id long, toxic int")
    found = weaklabel.learned_stems(docs, labels)
    assert found == brute_stems({t: x for _, t, x in rows}) and {b"zorgu", b"vexil"} <= found


def test_stems_find_words_never_seen(spark):
    rows = toxic_texts(2, 600)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(x)) for k, _, x in rows if k < 300], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in weaklabel.judged(docs, labels).collect()}
    rest = [(got[k], x) for k, _, x in rows if k >= 300]
    assert sum(a and b for a, b in rest) >= 0.95 * sum(b for _, b in rest)
    assert not any(a and not b for a, b in rest)


def brute_em(votes, rounds, silent):
    """Expectation-maximisation row by row, from the docstring of ``estimate``."""
    post = [1 / (1 + math.exp(-sum(v) * (3 if silent else 1))) for v in votes]
    for _ in range(rounds):
        chance = []
        for k in range(len(votes[0])):
            sums = {(c, x): (1 + (x == 2 * c - 1)) if x or not silent else 0 for c in (0, 1) for x in (-1, 0, 1)}
            for v, p in zip(votes, post):
                if v[k] or not silent:
                    sums[1, v[k]] += p
                    sums[0, v[k]] += 1 - p
            chance.append({(c, x): n / sum(sums[c, y] for y in (-1, 0, 1)) for (c, x), n in sums.items()})
        prior = (sum(post) + 1) / (len(votes) + 2)
        post = []
        for v in votes:
            a, b = (math.log(p) + sum(math.log(chance[k][c, x]) for k, x in enumerate(v) if x or not silent) for c, p in ((1, prior), (0, 1 - prior)))
            post.append(1 / (1 + math.exp(b - a)))
    return post


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(3)
    votes = [[rng.choice([-1, 0, 1]) if rng.random() < 0.3 else (1 if k % 3 else -1) for _ in range(4)] for k in range(150)]
    for silent in (False, True):
        found, _ = weaklabel.posteriors(spark.createDataFrame([(v,) for v in votes], "q array<int>"), "q", silent)
        want = brute_em(votes, 50, silent)
        assert max(abs(found[tuple(v)] - p) for v, p in zip(votes, want)) < 1e-6


def test_scorer_equals_brute_force():
    import numpy as np

    rng = random.Random(5)
    rows = [sorted(rng.sample(range(50), rng.randrange(1, 8))) for _ in range(40)]
    targets = [rng.random() for _ in rows]
    got = weaklabel.fit([np.array(r, np.int32) for r in rows], np.array(targets))
    w, seen = [0.0] * 51, [1e-8] * 51
    for _ in range(weaklabel.EPOCHS):
        grad = [0.0] * 51
        for r, y in zip(rows, targets):
            p = 1 / (1 + math.exp(-(sum(w[k] for k in r) / math.sqrt(len(r)) + w[50])))
            for k in r:
                grad[k] += (p - y) / len(rows) / math.sqrt(len(r))
            grad[50] += (p - y) / len(rows)
        for k in range(51):
            g = grad[k] + (1e-5 * w[k] / len(rows) if k < 50 else 0)
            seen[k] += g * g
            w[k] -= 0.5 * g / math.sqrt(seen[k])
    assert max(abs(a - b) for a, b in zip([*got[:50], got[-1]], w)) < 1e-9


def test_votes():
    stems = weaklabel.Stems(frozenset([b"zorgu", b"vexil"]))
    said = lambda t: weaklabel.described(t, stems)[1]
    assert said("an IDIOT, a loser.") == [1, 1, -1] and said("zorguba vexilto") == [0, 0, 1] and said("zorguba alone") == [0, 0, -1] and said(None) == [0, 0, -1]
    assert weaklabel.described("an idiot")[1] == [1, 0, 0]


def test_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "a few words of a text"), (None, "and other words")], "doc_id long, text string")
    assert weaklabel.judged(rows).count() == 2


def test_odd_texts(odd, nothing):
    rows = weaklabel.judged(odd).collect()
    assert len(rows) == 11 and all(0 <= r.quality_score <= 1 for r in rows)
    assert weaklabel.judged(nothing).count() == 0


def test_odd_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (3, None), (None, 1), (6, 0), (7, 1), (99, 1)], "doc_id long, toxic int").withColumns({c: F.lit("x") for c in ("text", "stem", "t", "c")})
    assert weaklabel.judged(odd, labels).count() == 11
    assert weaklabel.learned_stems(odd, labels.limit(0)) == weaklabel.learned_stems(odd, labels.withColumn("toxic", F.lit(1))) == frozenset()
    assert weaklabel.judged(nothing, labels).count() == 0
