from collections import defaultdict

from recordmill.llm import mixing


def water(sizes, cycle=(1, 2, 3)):
    """Targets by repeated capping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: cycle[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows)
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)


def test_small_sources_are_capped_and_blocks_are_cut(spark):
    rows = [(k, "w " * (k % 40), ["big", "tiny", None, "b"][0 if k < 160 else k % 4]) for k in range(200)]
    check(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=17).collect())


def test_slots_interleave(spark):
    per = spark.createDataFrame([(0, 10, 1, 0, 100, 0, 0), (1, 10, 1, 0, 300, 0, 100)], "sid int, nb long, q long, extra long, takes long, rest long, first long")
    order = [r.sid for r in mixing.schedule(per, 400).orderBy("k").collect()]
    assert order.count(0) == 100 and len(order) == 400
    for a in range(0, 400, 40):
        assert 7 <= order[a : a + 40].count(0) <= 13


def test_odd_texts(odd, nothing, spark):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11
    check(rows)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix(blank).collect()} == {0}


def test_documents_come_as_often_as_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    times = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).select("doc_id").collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in times.items() if v}


def test_the_sequence_takes_what_mix_says(spark):
    rows = [(None if k % 3 == 0 else k, " ".join(f"w{k}x{j}" for j in range(k % 60)), ["big", "tiny", None, "b"][0 if k < 250 else k % 4]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.pieces(docs, block_words=50).orderBy("k", "place").collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source, r.doc_id, r.h] += r.upto - r["from"]
    want = defaultdict(int)
    for r in mixing._taken(docs, (1, 2, 3), 50).collect():
        want[r.source, r.doc_id, r.h] += r.taken
    assert taken == {k: v for k, v in want.items() if v}
    # A slot's pieces lie side by side and are of one source; any stretch holds the sources in proportion.
    slots = defaultdict(list)
    for r in got:
        slots[r.k].append(r)
    for of in slots.values():
        assert len({r.source for r in of}) == 1 and of[0].place == 0
        assert all(a.place + a.upto - a["from"] == b.place for a, b in zip(of, of[1:]))
    order = [slots[k][0].source for k in sorted(slots)]
    share = order.count("big") / len(order)
    for a in range(0, len(order) - 32, 32):
        assert abs(order[a : a + 32].count("big") / 32 - share) < 0.2


def test_rows_without_ids_are_many_chunks(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('word ', id) text", "'s' source")
    sizes = mixing.sized(docs)
    assert sizes.select("h").distinct().count() == 3000


def test_repeated_rows_come_as_often_as_taken_together(spark):
    rows = [(1, "a b c", "s")] * 7 + [(k, "w " * 40, "t") for k in range(10, 40)] + [(50, "x y", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sum(-(-r.taken // r.size) for r in mixing.mix(docs).collect() if r.doc_id == 1)
    assert mixing.mixed_documents(docs).where("doc_id = 1").count() == want
