import random

import corpus_pipeline
from recordmill.llm import nearcopies
from recordmill.llm.bktree import lower_bytes

SF = "/root/testdata/sf0.01"


def brute_set(text):
    w = lower_bytes(text).split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """The smallest id that pairs of equal sets or of Jaccard 0.8 and more reach, all pairs tried."""
    sets = {k: brute_set(t) for k, t in sorted(texts.items())}
    first, root = {}, {}
    for k, s in sets.items():
        root[k] = first.setdefault(s, k)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    reps = list(first.items())
    for i, (s, a) in enumerate(reps):
        for t, b in reps[:i]:
            m, n = sorted((len(s), len(t)))
            if 5 * m >= 4 * n and 5 * (shared := len(s & t)) >= 4 * (m + n - shared):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in sets}


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_groups({r.doc_id: r.text for r in docs.collect()})
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()]
    assert sorted(got) == sorted(set(want.values()))


def altered(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.getrandbits(40)}"
    return words


def test_groups_of_edited_texts_equal_brute_force(spark):
    rng, texts = random.Random(6), {}
    for _ in range(12):
        base = [f"w{rng.getrandbits(30)}" for _ in range(300)]
        for n in (0, 2, 4, 5, 6, 7, 8, 9, 12):
            texts[len(texts)] = " ".join(altered(rng, base, n))
        now = base
        for _ in range(8):  # a chain, whose ends are far apart
            now = altered(rng, now, 5)
            texts[len(texts)] = " ".join(now)
    ids = rng.sample(range(10_000), len(texts))
    texts = dict(zip(ids, texts.values()))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.grouped(frame).collect()}
    assert got == brute_groups(texts)


def test_odd_rows(spark, odd, nothing):
    kept = nearcopies.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 6), (True, None)]
    rows = [(None, "no id"), (None, "No  ID"), (None, "another"), (None, "with an id"), (1, "with an id")]
    got = nearcopies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower().split()[0]) for r in got) == [(0, "another"), (0, "no"), (1, "with")]
    assert nearcopies.deduplicated(nothing).count() == 0


def test_tiles_of_large_buckets_equal_brute_force(spark, monkeypatch):
    """A group of which many pairs are near 0.8 and few links join all; tiles and streams of a few sets."""
    monkeypatch.setattr(nearcopies, "TILE", 4)
    monkeypatch.setattr(nearcopies, "STREAM", 16)
    monkeypatch.setattr(nearcopies, "DEALT", 8)
    rng, texts = random.Random(8), {}
    base = [f"w{rng.getrandbits(30)}" for _ in range(150)]
    for k in range(150):
        texts[k] = " ".join(altered(rng, base, rng.randrange(1, 9)))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.grouped(frame).collect()}
    want = brute_groups(texts)
    assert got == want and 3 < len(set(want.values())) < 140


def test_ranks_of_dealt_buckets_are_one_to_n(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "DEALT", 8)
    sizes = {1: 3, 2: 8, 3: 9, 4: 200}
    rows = [(key, 1000 * key + k, n) for key, n in sizes.items() for k in range(n)]
    members = spark.createDataFrame(rows, "key long, rep long, n long")
    got = nearcopies._ranked(members.where("key <> 2").selectExpr("*", "rep as root"), members).collect()
    ranks = {key: sorted(r["rank"] for r in got if r.key == key) for key in sizes}
    assert ranks == {key: [] if key == 2 else list(range(1, n + 1)) for key, n in sizes.items()}
    assert sorted((r.key, r.rep) for r in got) == sorted((k, rep) for k, rep, _ in rows if k != 2)


def test_fingerprints_and_trees_give_candidates(spark, monkeypatch):
    """Without any MinHash bucket, similar texts within two bits are found, and only these."""
    monkeypatch.setattr(nearcopies, "bands", lambda found: [])
    rng, texts = random.Random(9), {}
    for k in range(30):
        base = [f"w{rng.getrandbits(30)}" for _ in range(2000)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(altered(rng, base, 1 if k % 2 else 0))
    texts = {k: t if k % 4 != 1 else t.replace(" ", "\n") + " end" for k, t in texts.items()}
    prints = {k: nearcopies.bktree.simhash(nearcopies.shingles(t)) for k, t in texts.items()}
    want = {k: k - (k % 2 and (prints[k] ^ prints[k - 1]).bit_count() <= 2) for k in texts}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.grouped(frame).collect()} == want
    assert sum(k != c for k, c in want.items()) >= 20


def test_candidates_of_fingerprints_are_checked(spark, monkeypatch):
    """Where all sets have one fingerprint, those that are not similar to its first stay apart."""
    monkeypatch.setattr(nearcopies, "bands", lambda found: [])
    base = [f"w{k}" for k in range(300)]
    texts = {0: " ".join(base), 1: " ".join(altered(random.Random(1), base, 3)), 2: " ".join(altered(random.Random(2), base, 60)), 3: "something else"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    reps = nearcopies.signed(frame).selectExpr("doc_id as rep", "0L as fp", "bands")
    assert {r.node: r.root for r in nearcopies.joined_sets(frame, reps).collect()} == {0: 0, 1: 0}
