"""Chat formatting: quotations linked to the messages they quote, conversations in reply order without quotes.

1. Each text is parsed by line: leading ``>`` marks give the quote level; neighbouring lines of one level
   are a passage; a line that ends in ``wrote:`` above a passage belongs to the quote. The rest is the
   message's own text.
2. Passages, and their paragraphs and lines, are normalised (lower case, runs of other than letters and
   digits as one blank) and hashed, as are the own texts, paragraphs and lines of all messages. A passage
   links to an earlier message of its conversation that has its hash (the first such), else to the first
   in other conversations by (conv_id, turn); its whole text counts before paragraphs, those before lines.
   Originals are reduced to one row for each hash and conversation, and to a hash's first two
   conversations, before the join.
3. A message replies to the message that its first linked passage of level one quotes, if that is of its
   conversation, else to the message before it. Replies are ordered depth first, by turn, through the
   ranking of the tree's Euler tour: pointer jumping, in as many joins as the tour's length has bits.

Defined results: a null or empty text is an empty message without quotes; rows of a null conv_id or turn
have no place (null reply_to, depth and position) and are no originals; rows that repeat a conv_id and
turn share their place; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import lookup, remove, table

MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
BUCKET = 1024
WORDS = 2
PARSED = "conv_id long, turn long, role string, own string, quotes array<struct<p:int,level:int,keys:array<struct<rank:int,key:string,short:boolean>>>>, keys array<struct<key:string,short:boolean>>"


def normalised(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def digest(text: str) -> str | None:
    """Hash of the normalised text; None if nothing is left of it."""
    bare = normalised(text)
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if bare else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its passages as (level, text without marks)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        m = MARK.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if not last and own and own[-1].rstrip().endswith("wrote:"):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(n, "\n".join(x)) for n, x in passages]


def _keys(text: str) -> dict[str, tuple[int, bool]]:
    """Hashes of a text, its paragraphs and lines; the rank says which, the flag whether it is short."""
    found: dict[str, tuple[int, bool]] = {}
    for rank, parts in enumerate(([text], re.split(r"\n[ \t]*\n", text), text.split("\n"))):
        for part in parts:
            if key := digest(part):
                found.setdefault(key, (rank, len(normalised(part).split()) < WORDS))
    return found


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_key = pa.struct([("key", pa.string()), ("short", pa.bool_())])
        key = pa.struct([("rank", pa.int32()), ("key", pa.string()), ("short", pa.bool_())])
        quote = pa.struct([("p", pa.int32()), ("level", pa.int32()), ("keys", pa.list_(key))])
        for b in batches:
            own, quotes, keys = [], [], []
            for t in b.column(3):
                body, passages = parse(t.as_py())
                own.append(body)
                quotes.append([{"p": p, "level": n, "keys": [{"rank": r, "key": k, "short": few} for k, (r, few) in _keys(x).items()]} for p, (n, x) in enumerate(passages)])
                keys.append([{"key": k, "short": few} for k, (_, few) in _keys(body).items()])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(own, pa.string()), pa.array(quotes, pa.list_(quote)), pa.array(keys, pa.list_(own_key))],
                ["conv_id", "turn", "role", "own", "quotes", "keys"],
            )

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return messages.select(*(c.alias(n) for c, n in zip(columns, ("conv_id", "turn", "role", "text")))).mapInArrow(run, PARSED)


def before(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the largest ``value`` that a row of the same ``by`` and a smaller ``turn`` has; null if none.

    It is looked for inside buckets of turns, and for a bucket in the buckets before it, so that no group is one task's work.
    """
    rows = rows.withColumn("b", F.floor(F.col("turn") / BUCKET))
    ends = rows.groupBy(*by, "b").agg(F.max(value).alias("_most"))
    ends = ends.select(*by, "b", F.max("_most").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("_upto"))
    inside = rows.withColumn("_in", F.max(value).over(Window.partitionBy(*by, "b").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)))
    return inside.join(ends, [*by, "b"]).withColumn("before", F.coalesce("_in", "_upto")).drop("b", "_in", "_upto")


def links(messages: DataFrame) -> DataFrame:
    """A row for each passage that links: ``conv_id``, ``turn``, ``p``, ``level``, ``to_conv``, ``to_turn``."""
    placed = messages.where("conv_id is not null and turn is not null")
    quotes = placed.select("conv_id", "turn", F.explode("quotes").alias("x")).select("conv_id", "turn", "x.p", "x.level", F.explode("x.keys").alias("k"))
    quotes = table(quotes.select("conv_id", "turn", "p", "level", "k.rank", "k.key", "k.short").distinct())
    # What no one quotes is no original: a semi-join by key, hot keys broadcast.
    stated = table(placed.select("conv_id", "turn", F.explode("keys").alias("k")).select("conv_id", "turn", "k.key", "k.short").distinct())
    asked = table(quotes.groupBy("key").agg(F.lit(True).alias("asked")))
    originals = table(lookup(stated, asked, ["key"]).where("asked").drop("asked"))
    own = table(originals.where("not short").groupBy("key", "conv_id").agg(F.min("turn").alias("own_turn")))
    # The first of the two smallest conversations: one of them is not the quoter's. Two minima, so that no key is one task.
    first = table(own.groupBy("key").agg(F.min(F.struct("conv_id", F.col("own_turn").alias("turn"))).alias("first")))
    later = lookup(own, first.select("key", F.col("first.conv_id").alias("c")), ["key"]).where(F.col("conv_id") > F.col("c"))
    second = later.groupBy("key").agg(F.min(F.struct("conv_id", F.col("own_turn").alias("turn"))).alias("second"))
    first = table(first.join(second, "key", "left"))
    long = table(lookup(quotes.where("not short"), own, ["key", "conv_id"]))
    near = lookup(long, first, ["key"])
    same = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.col("rank"), F.lit(0).alias("far"), F.col("conv_id").alias("c"), F.col("own_turn").alias("t")))
    away = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    other = F.when(away.isNotNull(), F.struct(F.col("rank"), F.lit(1).alias("far"), away["conv_id"].alias("c"), away["turn"].alias("t")))
    best = near.select("conv_id", "turn", "p", "level", F.coalesce(same, other).alias("best"))
    few = quotes.where("short").select("conv_id", "turn", "key", "p", "level", "rank", F.lit(None).cast("long").alias("at"))
    said = originals.where("short").select("conv_id", "turn", "key", *(F.lit(None).cast("int").alias(c) for c in ("p", "level", "rank")), F.col("turn").alias("at"))
    latest = before(few.unionByName(said), ["conv_id", "key"], "at").where("at is null and before is not null")
    short = latest.select("conv_id", "turn", "p", "level", F.struct((F.col("rank") + 3).alias("rank"), F.lit(0).alias("far"), F.col("conv_id").alias("c"), F.col("before").alias("t")).alias("best"))
    found = best.unionByName(short).groupBy("conv_id", "turn", "p").agg(F.min("level").alias("level"), F.min("best").alias("best"))
    return found.where("best is not null").select("conv_id", "turn", "p", "level", F.col("best.c").alias("to_conv"), F.col("best.t").alias("to_turn"))


def replies(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and ``reply_to`` (a turn; null for the first) of each place."""
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    chain = before(turns.withColumn("own", F.col("turn")), ["conv_id"], "own")
    quoted = linked.where("level = 1 and to_conv = conv_id").groupBy("conv_id", "turn").agg(F.min_by("to_turn", "p").alias("quoted"))
    return chain.join(quoted, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"))


def reply_order(tree: DataFrame) -> DataFrame:
    """``tree(conv_id, turn, reply_to)`` with ``depth`` and ``position`` (depth first, replies by turn, from 0)."""
    tree = table(tree)
    children = tree.where("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    # The next reply to the same message is the one before it with the turns' signs changed.
    turned = before(tree.select("conv_id", "reply_to", (-F.col("turn")).alias("turn"), (-F.col("turn")).alias("own")), ["conv_id", "reply_to"], "own")
    siblings = turned.where("before is not null").select("conv_id", (-F.col("turn")).alias("turn"), (-F.col("before")).alias("sibling"))
    nodes = tree.join(siblings, ["conv_id", "turn"], "left").join(children, ["conv_id", "turn"], "left")
    down = nodes.select("conv_id", "turn", F.lit(0).alias("up"), F.coalesce("child", "turn").alias("nt"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("nu"))
    up = nodes.select(
        "conv_id", "turn", F.lit(1).alias("up"), F.coalesce("sibling", "reply_to").alias("nt"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("nu")
    )
    weight = {"n": (1 - F.col("up")).cast("long"), "d": (1 - 2 * F.col("up")).cast("long")}
    arcs = table(down.unionAll(up).withColumns(weight))
    rows = arcs.count()
    while True:
        open_ = arcs.where("nt is not null")
        if open_.isEmpty():
            break
        ahead = arcs.select("conv_id", F.col("turn").alias("nt"), F.col("up").alias("nu"), F.col("nt").alias("t2"), F.col("nu").alias("u2"), F.col("n").alias("n2"), F.col("d").alias("d2"))
        jumped = open_.join(ahead, ["conv_id", "nt", "nu"]).select(
            "conv_id", "turn", "up", F.col("t2").alias("nt"), F.col("u2").alias("nu"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d")
        )
        old, arcs = arcs, table(arcs.where("nt is null").unionAll(jumped), rows)
        remove(tree.sparkSession, old)
    sizes = tree.groupBy("conv_id").agg(F.count("*").alias("size"))
    down = table(arcs.where("up = 0").select("conv_id", "turn", (-F.col("d")).alias("depth"), F.col("n").alias("behind")))
    ranks = lookup(down, sizes, ["conv_id"])
    return tree.join(ranks.select("conv_id", "turn", "depth", (F.col("size") - F.col("behind")).alias("position")), ["conv_id", "turn"])


def linked_conversations(messages: DataFrame) -> DataFrame:
    """A row for each message: ``text`` without quotes, what it replies to, its place, and its quotes' links."""
    rows = table(parsed(messages))
    found = table(links(rows))
    order = reply_order(replies(rows, found))
    said = found.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("p", "level", "to_conv", "to_turn"))), lambda x: F.concat_ws(":", x["level"], x["to_conv"], x["to_turn"])), ",").alias("links")
    )
    body = rows.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"))
    placed = body.join(order, ["conv_id", "turn"], "left").join(said, ["conv_id", "turn"], "left")
    return placed.select("conv_id", "turn", "role", "text", "reply_to", "depth", "position", "n_quotes", F.coalesce("links", F.lit("")).alias("links"))
