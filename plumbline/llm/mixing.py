"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 %
of all words; none may exceed twice its own words, what is over goes to the others by
weight. A schedule of equal slots covers the whole mix: slot i sits at frac(i * golden ratio),
which is mapped through the cumulative target weights to a source, and the slots of a
source are ranked in order. All slots are of one size, the sum of the targets divided by the
number of slots: SLOTS (100,000), more where there are over a hundred sources. Each source's
documents, in the order of a hash, form one line of words, gone round at most twice and cut
into blocks of that size; the r-th slot of a source takes its r-th block. So a source takes what
the schedule deals to it: its target to within a few slots, as the sequence is of low
discrepancy; a source too small to meet a point has one slot after all others. A document's
taken words are what its source's slots take of it, and first_slot is the earliest of those.

Ranks and running sums are exact and spread: the schedule is ranked by counting within
ranges of slots, documents within hash buckets, as many as the root of the row count, and
buckets by their sums; so no window holds more than about that root, even for one source
or for one row repeated. Only the table of sources (one row each) is ordered in one task.
Texts are never shuffled, only their sizes.

Edge cases: null or blank texts have size 0 and nothing taken; null sources are one
source; repeated rows are separate documents, numbered so that each has its own place in the
line, and reruns agree; what the schedule deals beyond twice a source's words takes nothing;
an empty table gives an empty result; extra columns are kept by `mix` unless they bear its names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, unpacked, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SLOTS, SLOTS_A_SOURCE, BROADCAST_SOURCES = 100_000, 1000, 100_000
GOLDEN = 0.6180339887498949


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> also weight, target and place (order of the sources).

    Filling up: sources reach their cap in the order of cap / weight; the level at which the
    rest share what is left is found from running sums. One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", MOST * F.col("source_size"))
    rise = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("before", F.coalesce(F.sum("cap").over(rise), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(rise), F.lit(0.0)))
        .withColumn("level", (SHARE * F.sum("source_size").over(everyone) - F.col("before")) / F.col("rest"))
    )
    # The first source whose cap is above the level there fixes the level for it and all after it.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everyone)
    done = filled.withColumn("free", free["level"])
    target = F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("weight")))
    return done.select("source", "source_size", "place", "weight", target.alias("target"))


def points(i: Column) -> Column:
    """The place of slot i in the unit interval."""
    return i * GOLDEN - F.floor(i * GOLDEN)


def schedule(shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """place, r and i: every slot's source, its rank within the source and its number.

    The number of slots is given; ranks are counted within ranges of slots and added up, so no task ranks
    them all. A source without a point has one slot after all others.
    """
    spark = shares.sparkSession
    everyone = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    upto = shares.filter("target > 0").withColumn("hi", F.sum("target").over(everyone)).withColumn("total", F.sum("target").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    steps = upto.select("place", ((F.col("hi") - F.col("target")) / F.col("total")).alias("lo"), F.when(F.lead("place").over(Window.orderBy("place")).isNull(), 2.0).otherwise(F.col("hi") / F.col("total")).alias("hi"))
    # Both sides of the range join are cut into cells of the unit interval, so that it is an equi-join.
    cells = 1024
    at = spark.range(1, slots + 1).select(F.col("id").alias("i")).withColumn("u", points(F.col("i"))).withColumn("cell", F.floor(F.col("u") * cells))
    spread = steps.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1.0)) * cells))))
    dealt = at.join(spread, "cell").filter("u >= lo and u < hi").select("place", "i")
    missed = steps.join(dealt.select("place").distinct(), "place", "left_anti")
    dealt = dealt.unionByName(missed.select("place", (F.lit(slots + 1) + F.col("place")).alias("i")))
    ranged = dealt.withColumn("range", F.floor(F.col("i") / 4096))
    counts = ranged.groupBy("place", "range").agg(F.count("*").alias("n"))
    base = counts.select("place", "range", (F.sum("n").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    inner = ranged.withColumn("k", F.row_number().over(Window.partitionBy("place", "range").orderBy("i")) - 1)
    return inner.join(base, ["place", "range"]).select("place", (F.col("base") + F.col("k")).alias("r"), "i")


def copies(sized: DataFrame) -> DataFrame:
    """Adds copy: the number of a row among those of the same id, size and source, counted within each input partition and added up."""
    own = sized.withColumn("same", F.xxhash64(F.lit(3), "doc_id", "size", "place")).withColumn("from", F.shiftright("uid", 33))
    counts = own.groupBy("same", "from").agg(F.count("*").alias("n"))
    base = counts.select("same", "from", (F.sum("n").over(Window.partitionBy("same").orderBy("from").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    # Rows that are alone among their like need no window.
    several = base.join(counts.groupBy("same").agg(F.sum("n").alias("all")).filter("all > 1"), "same", "left_semi")
    near = own.join(several, ["same", "from"], "left")
    alone = near.filter("base is null").withColumn("copy", F.lit(0).cast("long"))
    ranked = near.filter("base is not null").withColumn("copy", F.col("base") + F.row_number().over(Window.partitionBy("same", "from").orderBy("uid")) - 1)
    return alone.unionByName(ranked).drop("same", "from", "base")


def lines(sized: DataFrame) -> DataFrame:
    """Adds a, b: where each row starts and ends on its source's line of words, in hash order."""
    buckets = max(1, math.isqrt(sized.count()))
    h = copies(sized).withColumn("h", F.xxhash64(F.lit(7), "doc_id", "size", "copy")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = h.groupBy("place", "bucket").agg(F.sum("size").alias("s"))
    base = sums.select("place", "bucket", (F.sum("s").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("base"))
    order = Window.partitionBy("place", "bucket").orderBy("h", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    inner = h.withColumn("upto", F.sum("size").over(order)).join(base, ["place", "bucket"])
    return inner.withColumn("b", F.col("base") + F.col("upto")).withColumn("a", F.col("b") - F.col("size")).drop("h", "bucket", "upto", "base", "copy")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns but those named here), doc_id, source, size, source_size, target, taken, first_slot (null if none is taken)."""
    names, row = packed(docs, ("doc_id", "source", "size", "source_size", "target", "taken", "first_slot"), keep)
    first = let(docs, doc_id=F.col(key).cast("long"), source=F.col(source), size=size_of(F.col(text)), row__=row)
    sized = written(first.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    shares = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    sources, total = shares.agg(F.count("*"), F.sum("target")).first()
    small = F.broadcast(shares) if sources <= BROADCAST_SOURCES else shares
    placed = sized.join(small.select(F.col("source").alias("s"), "place", "source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    on_line = lines(placed.filter("size > 0").select("uid", "doc_id", "place", "source_size", "size"))
    slots = max(slots, SLOTS_A_SOURCE * sources)
    step = (total or 0.0) / slots or 1.0
    slot = written(schedule(shares, slots), "slots")
    # The r-th slot of a source takes words r*step to (r+1)*step of the line, gone round twice; which of these blocks exist, the schedule says.
    edge = lambda r: F.floor(r * step + 0.5)
    turns = on_line.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"from": F.col("a") + F.col("turn") * F.col("source_size"), "to": F.col("b") + F.col("turn") * F.col("source_size")})
    parts = turns.withColumn("r", F.explode(F.sequence(F.greatest(F.floor(F.col("from") / step) - 1, F.lit(0)), F.floor(F.col("to") / step) + 1)))
    parts = parts.withColumn("part", F.least("to", edge(F.col("r") + 1)) - F.greatest("from", edge(F.col("r")))).filter("part > 0")
    taken = parts.join(slot, ["place", "r"]).groupBy("uid").agg(F.sum("part").alias("taken"), F.min("i").alias("first_slot"))
    out = sized.join(taken, "uid", "left").join(small, sized.source.eqNullSafe(shares.source))
    return out.select(sized.doc_id, sized.source, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", *unpacked(names))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, keep=[]).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
