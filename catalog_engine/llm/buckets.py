"""Classes of members that share buckets, without a row for every pair of a bucket.

In a first round the members of a bucket are compared with its centre: the member that shares most
buckets with others. In a second round another centre is drawn. What is then connected need not be
compared. In the end all members of a bucket that are not in its main component are compared with
all its members, block by block, so the classes are those that all pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.llm.common import discard, stage
from catalog_engine.llm.components import components

#: Rounds in which the members of a bucket meet one centre.
ROUNDS = 2
#: Members that are compared at a time in the end.
BLOCK = 256
#: Blocks of a bucket up to which a block has that many members, where members are small.
GRID = 4


def blocks_of(n: Column, most: int = BLOCK) -> Column:
    """Blocks of a bucket of ``n`` members. Each block is sent to every other one, so what is sent is the
    bucket times its blocks: beyond GRID of them they grow, up to ``most`` members."""
    return F.greatest(F.least(F.ceil(n / BLOCK), F.lit(GRID)), F.ceil(n / most)).cast("long")


def shared(exploded: DataFrame) -> DataFrame:
    """Rows (bucket, rep, n) of buckets with two members or more; n is their number."""
    full = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return exploded.join(full, "bucket")


def _pairs(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _met(known: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members and centres of their buckets, one for each member."""
    by = F.xxhash64("rep", F.lit(turn)) if turn else F.struct("weight", F.col("rep"))
    centre = (
        known.groupBy("bucket")
        .agg(
            F.max_by(F.struct("rep", "comp"), by).alias("c"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
        )
        .where("low < high")
        .select("bucket", F.col("c.rep").alias("centre"), F.col("c.comp").alias("centre_comp"))
    )
    met = known.join(centre, "bucket").where("comp <> centre_comp")
    # Of the centres a member meets, the one it shares most buckets with.
    best = (
        met.groupBy("rep", "centre")
        .agg(F.count("*").alias("n"))
        .groupBy("rep")
        .agg(F.max_by("centre", F.struct("n", F.col("centre"))).alias("centre"))
    )
    return _pairs(best, "rep", "centre")


def _open_blocks(known: DataFrame, sets: DataFrame, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks (bucket, one, two) of structs (rep, comp, data): in each bucket of several
    components the members outside the main one, and all members. And the staged table they are read from."""
    sizes = known.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    main = (
        sizes.groupBy("bucket")
        .agg(
            F.max_by("comp", F.struct("n", "comp")).alias("main"),
            F.count("*").alias("k"),
            blocks_of(F.sum("n"), most).alias("blocks"),
        )
        .where("k > 1")
    )
    mixed = (
        known.join(main, "bucket")
        .join(sets, "rep")
        .select(
            "bucket",
            F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"),
            "blocks",
            F.struct("rep", "comp", "data").alias("member"),
            (F.col("comp") != F.col("main")).alias("outside"),
        )
    )
    packed = stage(
        mixed.groupBy("bucket", "block", "blocks").agg(
            F.collect_list("member").alias("two"),
            F.collect_list(F.when(F.col("outside"), F.col("member"))).alias("one"),
        ),
        "blocks",
    )
    # Both sides are dealt out by bucket and block, so that a large bucket meets in many tasks.
    outside = packed.where(F.size("one") > 0).select(
        "bucket", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    met = outside.join(packed.select("bucket", "block", "two"), ["bucket", "block"])
    return met.select("bucket", "one", "two"), packed


def _partners(pairs: DataFrame) -> DataFrame:
    """For each end of pairs (a, b, n) the one with the largest n, as pairs (a, b)."""
    both = pairs.select("a", "b", "n").union(pairs.select("b", "a", "n"))
    return _pairs(both.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")), "a", "b")


def _open_pairs(pairs: DataFrame, asked: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, n) that were not asked for and whose ends are not connected."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("c"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("d"))
    left = pairs.join(asked, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    return left.where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b", "n")


def links(
    members: DataFrame,
    sets: DataFrame,
    similar: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame], DataFrame],
    rounds: int = ROUNDS,
    pairs: DataFrame | None = None,
    most: int = BLOCK,
) -> DataFrame:
    """Links (a, b) that connect the similar members of buckets (bucket, rep, n), and the similar ones
    of further ``pairs`` (a, b, n): of these, too, each member meets one partner before the others.

    ``sets`` has the ``data`` of each ``rep``. ``similar`` gives those of the pairs (a, b) that are
    similar enough, ``compare`` links (a, b) that connect what is similar in pairs of blocks
    (bucket, one, two), of up to ``most`` members. Pairs are staged, so the work on them is not repeated.
    """
    weight = F.sum("n").over(Window.partitionBy("rep")).alias("weight")
    members = stage(members.select("bucket", "rep", weight), "weighted")
    known, made = members.withColumn("comp", F.col("rep")), None
    for turn in range(rounds):
        asked = _met(known, turn)
        if pairs is not None:
            asked = asked.union(_partners(pairs)).distinct()
        asked = stage(asked, "pairs")
        found = stage(similar(asked), "similar")
        made = found if made is None else made.union(found)
        labels = stage(components(made), "labels")
        if pairs is not None:
            pairs = stage(_open_pairs(pairs, asked, labels), "pairs")
        known = members.join(labels, members["rep"] == labels["node"], "left").select(
            "bucket", "rep", "weight", F.coalesce("component", "rep").alias("comp")
        )
    blocks, packed = _open_blocks(known, sets, most)
    found = compare(blocks)
    if pairs is not None:
        found = found.union(similar(pairs.select("a", "b")))
    found = stage(found, "similar")
    # The members of blocks come with their data.
    discard(members, packed)
    return found if made is None else made.union(found)


def classes(
    members: DataFrame,
    sets: DataFrame,
    similar: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame], DataFrame],
    rounds: int = ROUNDS,
) -> DataFrame:
    """``node`` and ``component`` of the members of buckets that ``links`` connects."""
    return stage(components(links(members, sets, similar, compare, rounds)), "labels")
