import random

from recordmill.llm import common, quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def placed(spark, rows):
    return {(r.conv_id, r.turn): r for r in quotes.linked_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_parse():
    own, found = quotes.parse("Hi\nAnn wrote:\n> one\n> two\n>> deep\n> three\nbye\n")
    assert own == "Hi\nbye" and found == [(1, "one\ntwo"), (2, "deep"), (1, "three")]


def test_links_and_order(spark):
    rows = [
        (1, 0, "a", "First message here"), (1, 1, "b", "Second message\nwith two lines"), (1, 2, "a", "> first MESSAGE, here\nA reply to the first"),
        (1, 3, "b", "> second message\nReply to a line"), (1, 4, "a", "> Reply to a line\n>> second message\nDeeper"), (1, 5, "b", "> nobody said this\nPlain"),
        (2, 0, "a", "> First message here\nfrom elsewhere"),
    ]
    got = placed(spark, rows)
    assert [got[1, t].reply_to for t in range(6)] == [None, 0, 0, 1, 3, 4]
    assert sorted(range(6), key=lambda t: got[1, t].position) == [0, 1, 3, 4, 5, 2]
    assert [got[1, t].depth for t in range(6)] == [0, 1, 1, 2, 3, 4]
    assert got[1, 4].links == "1:1:3,2:1:1" and got[1, 5].links == "" and got[1, 5].n_quotes == 1
    assert got[2, 0].links == "1:1:0" and got[2, 0].reply_to is None
    assert got[1, 3].text == "Reply to a line"


def test_quoted_elsewhere_though_restated_here(spark):
    rows = [
        (1, 0, "a", "> Some passage\nreply"), (1, 1, "b", "Some passage"), (2, 3, "a", "some passage"), (3, 0, "a", "Some passage"),
        (4, 0, "a", "> Own words\nOwn words"), (5, 0, "a", "> some passage\nx"),
    ]
    got = placed(spark, rows)
    assert got[1, 0].links == "1:2:3" and got[5, 0].links == "1:1:1" and got[4, 0].links == ""


def test_short_lines_link_to_the_latest(spark):
    rows = [(1, 0, "a", "Thanks\nfirst things"), (1, 1, "b", "Thanks"), (1, 2, "a", "> Thanks\nyou are welcome"), (1, 3, "b", "> Thanks\n> first things and more\nhm"), (2, 0, "a", "> Thanks\nnothing here")]
    got = placed(spark, rows)
    assert got[1, 2].links == "1:1:1" and got[1, 2].reply_to == 1
    assert got[1, 3].links == "1:1:1" and got[2, 0].links == ""


def brute_links(rows):
    """Links and replies by looking at all messages for each passage."""
    held = {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            for key, (_, few) in quotes._keys(quotes.parse(text)[0]).items():
                held.setdefault(key, set()).add((conv, turn))
    links, reply = {}, {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        found = []
        for p, (level, passage) in enumerate(quotes.parse(text)[1]):
            options = []
            for key, (rank, few) in quotes._keys(passage).items():
                here = [t for c, t in held.get(key, ()) if c == conv]
                if few:
                    if early := [t for t in here if t < turn]:
                        options.append((rank + 3, 0, conv, max(early)))
                elif here and min(here) < turn:
                    options.append((rank, 0, conv, min(here)))
                elif away := [(c, t) for c, t in held.get(key, ()) if c != conv]:
                    options.append((rank, 1, *min(away)))
            if options:
                found.append((p, level, *min(options)[2:]))
        links[conv, turn] = ",".join(f"{n}:{c}:{t}" for _, n, c, t in found)
        quoted = [t for p, n, c, t in found if n == 1 and c == conv]
        early = [t for c, t, _, _ in rows if c == conv and t is not None and t < turn]
        reply[conv, turn] = quoted[0] if quoted else max(early, default=None)
    return links, reply


def test_links_and_replies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BUCKET", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    rng = random.Random(4)
    lines = ["Thanks", "Ok.", "ok then", "a line that everyone quotes", *(f"line number {k} of the talk" for k in range(25))]
    rows = []
    for conv in range(8):
        for turn in range(25):
            parts = []
            for _ in range(rng.randrange(0, 3)):
                mark = rng.choice(["> ", ">> ", "> > "])
                parts += [mark + rng.choice([lines[2], rng.choice(lines)]) for _ in range(rng.randrange(1, 3))] + [""]
            parts += rng.sample(lines, rng.randrange(0, 3))
            rows.append((conv, turn, "u", "\n".join(parts)))
    want, reply = brute_links(rows)
    got = placed(spark, rows)
    assert {k: r.links for k, r in got.items()} == want and sum(map(bool, want.values())) > 80
    assert {k: r.reply_to for k, r in got.items()} == reply
    for conv in range(8):
        parent = {t: p for (c, t), p in reply.items() if c == conv}
        assert [t for t, _ in sorted(((t, got[conv, t].position) for t in parent), key=lambda x: x[1])] == brute_order(parent)


def test_every_planted_quote_is_found_on_the_whole_table(spark):
    """A reply that quotes its conversation's first message is put after each conversation of the table."""
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    first, last = {}, {}
    for conv, turn, _, text in table:
        first[conv] = min(first.get(conv, (turn, text)), (turn, text))
        last[conv] = max(last.get(conv, turn), turn)
    more = [(c, last[c] + 1, "user", "\n".join("> " + x for x in text.split("\n")) + "\nI see") for c, (_, text) in first.items()]
    got = placed(spark, table + more)
    found = sum(got[c, t].reply_to == first[c][0] for c, t, _, _ in more)
    assert found >= 0.98 * len(more)


def brute_order(parent):
    out, todo = [], [t for t, p in sorted(parent.items(), reverse=True) if p is None]
    while todo:
        t = todo.pop()
        out.append(t)
        todo += sorted((c for c, p in parent.items() if p == t), reverse=True)
    return out


def test_order_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BUCKET", 8)
    rng, rows = random.Random(3), []
    for conv in range(5):
        for turn in range(1 + 20 * conv):
            body = f"message {conv} {turn}"
            rows.append((conv, turn, "u", f"> message {conv} {rng.randrange(turn)}\n{body}" if turn and rng.random() < 0.5 else body))
    got = placed(spark, rows)
    for conv in range(5):
        parent = {t: got[conv, t].reply_to for c, t in got if c == conv}
        want = brute_order(parent)
        assert [t for t, _ in sorted(((t, got[conv, t].position) for t in parent), key=lambda x: x[1])] == want


def test_odd_rows(spark):
    rows = [(None, 0, "u", "x"), (1, None, "u", "> x"), (2, 0, None, None), (2, 0, "u", ""), (2, 5, "u", "y " * 100_000), (2, 5, "u", "y " * 100_000), (2, 7, "u", ">" * 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: df["role"] for c in ("own", "quotes", "keys", "p", "depth", "position", "links", "up")})
    got = quotes.linked_conversations(clash).collect()
    assert len(got) == 7
    assert {r.position for r in got if r.conv_id is None or r.turn is None} == {None}
    assert sorted(r.position for r in got if r.conv_id == 2 and r.turn is not None) == [0, 0, 1, 1, 2]
    assert quotes.linked_conversations(df.limit(0)).count() == 0
