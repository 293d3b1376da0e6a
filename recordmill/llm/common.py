"""What the operators share: scratch tables in the shared folder, words, spans and components.

Scratch tables are Parquet files under ``spark.checkpoint.dir``. They cut lineage and
survive the loss of any executor, because every later stage reads files and not blocks
that one executor holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word definition in this subpackage: blank, tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: ``lookup`` takes a key as hot that has over a HOT_SHARE-th of all rows, and over HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1000, 5000
#: Elements whose running totals are taken at once.
RUN = 256
#: This driver's folder in local mode.
_OWN: list[str] = []
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one. Where none is configured, local mode gets a temporary one; a cluster is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN.append(tempfile.mkdtemp(prefix="recordmill-")) if not _OWN else None
        top = f"file://{_OWN[0]}"
    return f"{top.rstrip('/')}/recordmill/{uuid.uuid4().hex}"


def table(df: DataFrame, rows_hint: int | None = None) -> DataFrame:
    """``df`` written once and read again. With ``rows_hint``, small results go to few files."""
    path = shared_dir(df.sparkSession)
    if rows_hint is not None:
        df = df.coalesce(max(1, -(-rows_hint // 400_000)))
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove(spark: SparkSession, done: DataFrame) -> None:
    """Takes a scratch table away that no plan reads any more; other DataFrames stay."""
    if path := getattr(done, "scratch", None):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words between blanks; empty for null or blank texts. JVM only."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where an inner function would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of ints under an associative ``step``, one for each element. JVM only.

    An array grows by copying, so totals are taken inside runs of ``RUN`` elements, then over the runs' last totals:
    work and memory stay close to linear in the array's length.
    """

    def totals(xs: Column, of: Callable[[Column], Column]) -> Column:
        """The start, and the totals after it."""
        return F.aggregate(xs, F.array(F.lit(start)), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), of(x)))))

    def runs(xs: Column) -> Column:
        places = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: totals(F.slice(xs, k + 1, RUN), lambda x: x))

    def joined(r: Column, before: Column) -> Column:
        return F.flatten(F.transform(r, lambda x, k: F.transform(F.slice(x, 2, RUN), lambda y: step(F.get(before, k), y))))

    return let(numbers, lambda xs: let(runs(xs), lambda r: let(totals(r, lambda x: F.element_at(x, -1)), lambda o: joined(r, o))))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; other letters stay as they are."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def lookup(left: DataFrame, right: DataFrame, on: list[str], total: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key at most; null where it has none.

    A key that holds over a ``HOT_SHARE``-th of ``left`` (a table) would be one task's work. There are at most ``HOT_SHARE``
    such keys, so their rows of ``right`` are broadcast and the rows of ``left`` stay where they are; all others are shuffled.
    ``total`` is the number of rows of ``left``, or more, where it is known; they are counted otherwise.
    """
    total = left.count() if total is None else total
    hot = []
    if total > HOT_ROWS:
        most = max(total // HOT_SHARE, HOT_ROWS)
        hot = left.where(" and ".join(f"`{c}` is not null" for c in on)).groupBy(*on).count().where(F.col("count") > most).select(*on).collect()
    if not hot:
        return left.join(right, on, "left")
    spark = left.sparkSession
    keys = F.broadcast(spark.createDataFrame(hot, left.select(*on).schema))  # HOT_SHARE rows at most
    some = F.broadcast(right.join(keys, on, "left_semi"))
    rest = left.join(keys, on, "left_anti").join(right, on, "left")
    return left.join(keys, on, "left_semi").join(some, on, "left").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; root is the smallest node.

    Every round hooks each node to its smallest smaller neighbour, flattens these trees by
    pointer jumping and contracts the edges. Only aggregates and equi-joins are used and
    nothing is collected but whether rows are left. Nodes without an edge are not returned.
    Tables of earlier rounds are removed as soon as a later one is written.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b")
    links = table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = links.count()
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    labels = table(nodes.withColumn("root", F.col("node")), 2 * n)
    many = labels.count()
    while n:
        old = [links, labels]
        tree = table(links.groupBy("u").agg(F.min("v").alias("p")), n)
        while True:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = table(lookup(tree, up, ["p"], n).select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), n)
            old += [tree, jumped]
            tree = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        roots = tree.select(F.col("u").alias("root"), F.col("p").alias("top"))
        labels = table(lookup(labels, roots, ["root"], many).select("node", F.coalesce("top", "root").alias("root")), many)
        one = table(lookup(links, tree, ["u"], n).select(F.col("p").alias("x"), "v"), n)
        old.append(one)
        both = lookup(one, tree.select(F.col("u").alias("v"), "p"), ["v"], n).select("x", F.coalesce("p", "v").alias("y"))
        links = table(both.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), n)
        n = links.count()
        for t in old:
            remove(spark, t)
    return labels
