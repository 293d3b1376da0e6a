"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

1. Sources get targets: shares of all words by weight, at most ``MOST`` times their own size, with
   the excess dealt out anew by weight. That is one level of water, found with two running sums.
2. Each source's documents, in the order of a hash, form one stream of words, cut into blocks of
   equal length (to a word). A target is a number of block takes, the last one cut short.
3. Slot k is the k-th van der Corput point (the reversed bits of k). The points, scaled, run
   through the cumulative takes of the sources, so that any stretch of the schedule holds the
   sources in proportion. A slot's rank in its source names the block; past the last block the
   stream begins again.
4. Blocks join the documents that they cover: ``pieces`` is the mixed sequence, slot by slot, and what is taken of a
   document is the sum of its pieces.

Only DataFrame functions are used. Running sums are taken in two steps, inside chunks of bounded
size and over the chunks' totals, so that a source with a third of all rows is no single task.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
the last; with no words at all, targets are 0; repeated rows are separate documents; documents are ordered by a
hash of doc_id and text, so that rows without an id are spread as well, and ties are broken by size; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import table, words_of

MOST = 3
BLOCK_WORDS = 2048
CHUNK_ROWS = 8192
CHUNK_SLOTS_BITS = 13
CELLS = 4096
SEED = 7


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words of the whole text) and ``h`` (the hash that orders) of each row."""
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"), _order().alias("h"))


def _order() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", "text")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row for each source: ``sid`` (its rank by code point), ``source_size``, ``rows``, ``target``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # One row a source from here on; the windows without a partition see no documents.
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.lit(list(cycle)), (F.col("sid") % len(cycle) + 1).cast("int")).cast("double"))
    most = (MOST * F.col("source_size")).cast("double")
    everything = Window.partitionBy()
    before = Window.orderBy(most / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("_level", F.when(most / F.col("weight") >= level, level))
    water = F.coalesce(F.max("_level").over(everything), F.lit(0.0))
    return per.withColumn("target", F.least(most, F.col("weight") * water)).drop("_level", "weight")


def _blocks(per: DataFrame, block_words: int) -> DataFrame:
    """Adds block counts, the words to take and the takes (slots) of each source, and where its slots begin."""
    s = F.col("source_size")
    per = per.withColumn("nb", F.greatest(F.lit(1), F.ceil(s / block_words)).cast("long"))
    per = per.withColumns({"q": F.expr("source_size div nb"), "extra": F.expr("source_size % nb"), "words": F.least(F.round("target").cast("long"), MOST * s)})
    per = per.withColumns({"passes": F.expr("if(source_size = 0, 0L, words div source_size)"), "rest": F.expr("if(source_size = 0, 0L, words % source_size)")})
    per = per.withColumn("takes", F.col("passes") * F.col("nb") + F.when(F.col("rest") > 0, block_of(F.col("rest") - 1) + 1).otherwise(0))
    return per.withColumn("first", F.coalesce(F.sum("takes").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def block_of(place: Column) -> Column:
    """The block that holds a word's place: the first ``extra`` blocks have ``q + 1`` words, the others ``q``."""
    long = F.col("extra") * (F.col("q") + 1)
    return F.when(place < long, F.floor(place / (F.col("q") + 1))).otherwise(F.col("extra") + F.floor((place - long) / F.greatest(F.col("q"), F.lit(1)))).cast("long")


def start_of(block: Column) -> Column:
    return block * F.col("q") + F.least(block, F.col("extra"))


def schedule(per: DataFrame, slots: int) -> DataFrame:
    """The slots in order: ``k``, ``sid``, ``rank`` (in the source, from 0), ``block``, ``cut`` (words if cut short).

    Points are the reversed bits of k; those from ``slots`` on fall away, so each place of the
    cumulative takes is met exactly once and every source gets exactly its takes.
    """
    spark = per.sparkSession
    bits = max(1, (slots - 1).bit_length())
    cell = max(1, slots // CELLS)
    at = F.conv(F.reverse(F.lpad(F.bin("k"), bits, "0")), 2, 10).cast("long")
    points = spark.range(1 << bits).select(F.col("id").alias("k")).withColumn("x", at).where(F.col("x") < slots).withColumn("cell", F.floor(F.col("x") / cell))
    owners = per.where("takes > 0").select(
        "sid", "nb", "q", "extra", "takes", "rest", "first", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("takes") - 1) / cell))).alias("cell")
    )
    placed = points.join(owners, "cell").where("x >= first and x < first + takes").withColumn("chunk", F.shiftright("k", CHUNK_SLOTS_BITS))
    placed = placed.withColumn("_in", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("k")) - 1)
    counts = points.join(owners, "cell").where("x >= first and x < first + takes").groupBy("sid", F.shiftright("k", CHUNK_SLOTS_BITS).alias("chunk")).count()
    offsets = counts.select(
        "sid", "chunk", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")
    )
    ranked = placed.join(offsets, ["sid", "chunk"]).withColumn("rank", F.col("_in") + F.col("_off")).withColumn("block", F.col("rank") % F.col("nb"))
    cut = F.when((F.col("rank") == F.col("takes") - 1) & (F.col("rest") > 0), F.col("rest") - start_of(F.col("block")))
    return ranked.select("k", "sid", "rank", "block", cut.alias("cut"))


def _placed(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """``sizes`` with their source's columns and ``a``, the place of their first word in its stream."""
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).drop(per["source"])
    rows = rows.withColumns({"_bits": F.expr(f"int(ceil(log2(greatest(1.0D, rows / {CHUNK_ROWS}.0D))))")})
    # The order of h, a signed number, is that of its upper bits with the sign flipped.
    rows = rows.withColumn("_chunk", F.expr("if(_bits = 0, 0L, shiftrightunsigned(h ^ shiftleft(1L, 63), 64 - _bits))"))
    inside = Window.partitionBy("sid", "_chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("sid", "_chunk").agg(F.sum("size").alias("_sum"))
    off = sums.select(
        "sid", "_chunk", F.coalesce(F.sum("_sum").over(Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    rows = rows.withColumn("_upto", F.sum("size").over(inside))
    return rows.join(off, ["sid", "_chunk"]).withColumn("a", F.col("_before") + F.col("_upto") - F.col("size")).drop("_bits", "_chunk", "_before", "_upto")


OUT = ["doc_id", "source", "size", "source_size", "target"]


def _mixed(docs: DataFrame, cycle: tuple[int, ...], block_words: int) -> tuple[DataFrame, DataFrame | None]:
    """The documents with their places, and for each document and slot that takes of it a piece; None if there is no slot."""
    sizes = table(sized(docs))
    per = table(_blocks(targets(sizes, cycle), block_words), 1)
    slots = per.agg(F.sum("takes")).first()[0] or 0
    rows = _placed(sizes, per)
    if not slots:
        return rows, None
    has = rows.where("size > 0").withColumn("block", F.explode(F.sequence(block_of(F.col("a")), block_of(F.col("a") + F.col("size") - 1))))
    start = start_of(F.col("block"))
    upto = F.least(F.col("a") + F.col("size"), start_of(F.col("block") + 1), start + F.coalesce("cut", F.lit(2**62)))
    spans = has.join(schedule(per, slots).select("k", "sid", "block", "cut"), ["sid", "block"], "left")
    return rows, spans.withColumns({"from": F.greatest("a", start) - F.col("a"), "upto": F.greatest("a", start, upto) - F.col("a")})


def pieces(docs: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed sequence: ``k`` (the slot) and ``place`` (of the piece in it), the document, and its words ``from`` to ``upto``."""
    rows, spans = _mixed(docs, cycle, block_words)
    if spans is None:
        return rows.limit(0).select(F.lit(0).cast("long").alias("k"), F.col("a").alias("place"), "doc_id", "source", "h", F.col("a").alias("from"), F.col("a").alias("upto"))
    return spans.where("k is not null and upto > from").select("k", (F.col("a") + F.col("from") - start_of(F.col("block"))).alias("place"), "doc_id", "source", "h", "from", "upto")


def _taken(docs: DataFrame, cycle: tuple[int, ...], block_words: int) -> DataFrame:
    rows, spans = _mixed(docs, cycle, block_words)
    none = F.lit(0).cast("long").alias("taken")
    if spans is None:
        return rows.select(*OUT, "h", none)
    words = F.sum(F.when(F.col("k").isNotNull(), F.col("upto") - F.col("from")).otherwise(0)).alias("taken")
    return spans.groupBy("sid", "a", "h", *OUT).agg(words).select(*OUT, "h", "taken").unionAll(rows.where("size = 0").select(*OUT, "h", none))


def mix(docs: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (words, the sum of its pieces) of each row of ``docs``."""
    return _taken(docs, cycle, block_words).select(*OUT, "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them, whole: a document partly taken comes once more, one not taken is gone.

    Rows that agree in doc_id, source and text come as often as they are taken together.
    """
    times = F.ceil(F.col("taken") / F.col("size"))
    copies = _taken(docs, (1, 2, 3), BLOCK_WORDS).where("size > 0").groupBy("doc_id", "source", "size", "h").agg(F.sum(times).cast("long").alias("_all"), F.count("*").alias("_rows"))
    copies = table(copies.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("h").alias("_h"), F.expr("_all div _rows").alias("_each"), F.expr("_all % _rows").alias("_rest")))
    rows = docs.select(*docs.columns, F.size(words_of(F.col("text"))).cast("long").alias("_size"), _order().alias("_hash"))

    def among(which: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(which["_i"]) & rows["source"].cast("string").eqNullSafe(which["_s"]) & (rows["_size"] == which["_n"]) & (rows["_hash"] == which["_h"])
        return rows.join(which, same)

    out = among(copies.where("_each > 0")).withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_each").cast("int")))).select(*docs.columns)
    rest = copies.where("_rest > 0")
    if rest.isEmpty():  # only repeated rows leave a rest
        return out
    one = among(rest).dropDuplicates(["_i", "_s", "_n", "_h"])
    some = one.withColumn("_many", F.explode(F.expr(f"sequence(0L, (_rest - 1) div {CHUNK_ROWS})"))).withColumn("_one", F.explode(F.expr(f"sequence(1L, least({CHUNK_ROWS}L, _rest - _many * {CHUNK_ROWS}))")))
    return out.unionAll(some.select(*docs.columns))
