import random

import xxhash

from recordmill.llm import bktree


def brute_print(text):
    w = bktree.lower_bytes(text).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    """Smallest key that links of two bits or less reach, all pairs tried."""
    keys = list(prints)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def test_fingerprint():
    for t in (None, "", " ", "one", "One two", "a b c d e f g A B C", "x y z " * 50):
        assert bktree.fingerprint(t) == brute_print(t)


def test_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = bktree.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.within(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_every_pair_within_two_bits_shares_a_shard_at_each_level():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        alive = {-1}
        for level in bktree._levels():
            alive = {k for k, mask, above in level if above in alive and a & mask == b & mask}
            assert alive


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in bktree.grouped(docs).collect()}
    want = brute_components(dict(sorted(prints.items())))
    assert got == {k: (prints[k], want[k]) for k in prints}


def test_large_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(bktree, "SHARD", 4)
    rng = random.Random(3)
    base = rng.getrandbits(62)
    fps = sorted({base ^ rng.getrandbits(9) for _ in range(120)} | {rng.getrandbits(62) for _ in range(50)})
    frame = spark.createDataFrame([(bktree._signed(x), k) for k, x in enumerate(fps)], "fp long, rep long")
    found = bktree.components(bktree.links(frame))
    want = {k: v for k, v in brute_components(dict(enumerate(fps))).items()}
    got = {r.node: r.root for r in found.collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_odd_texts(odd, nothing):
    rows = {(r.doc_id, r.fp): r.component_id for r in bktree.grouped(odd).collect()}
    assert rows[0, 0] == rows[1, 0] == rows[2, 0] == 0
    assert rows[7, next(f for d, f in rows if d == 7)] == 6
    kept = bktree.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 0 in ids and 1 not in ids and 6 in ids and 7 not in ids
    assert bktree.deduplicated(nothing).count() == 0
