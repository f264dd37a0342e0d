"""The composite similarity of a pool: surface, structure, naming, vectors and pattern entropy in one score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import syntax
from ..functions import text as tx
from .kernels import BROADCAST_ROWS, cut_lineage
from .stats import counts, diversity

# Weights of the composite, and the number of pairs drawn from a pool.
WEIGHTS = {"ngram": 0.15, "ast": 0.25, "naming": 0.20, "vector": 0.30, "pattern": 0.10}
PAIRS = 500
#: Pools of up to so many pairs are listed to draw from; of more, pair numbers are drawn, twice as many as needed.
LISTED = 20_000


def drawn_pairs(sizes: DataFrame, group: list[str], most: int = PAIRS) -> DataFrame:
    """group, i, j: all pairs i < j of the places 0 .. n-1 of each group, or `most` of them, distinct and drawn by key from all."""
    of = sizes.filter("n > 1").select(*group, F.expr("n * (n - 1) div 2").alias("all"))
    listed = F.col("all") <= LISTED
    k = of.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.when(listed, F.col("all") - 1).otherwise(2 * most - 1))))
    draw = lambda seed: tx.drawn(F.lit(seed), *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group], F.col("k").cast("string"))
    wide = (draw("pairs") % (1 << 31)) * (1 << 32) + draw("more")
    p = k.select(*group, F.when(listed, F.col("k")).otherwise(wide % F.col("all")).alias("p"), F.when(listed, draw("pairs")).otherwise(F.col("k")).alias("r"))
    p = p.groupBy(*group, "p").agg(F.min("r").alias("r"))
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy("r", "p"))).filter(F.col("rn") <= most)
    # Pair number p is j (j - 1) / 2 + i; the root may be off by one for large p.
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2)
    p = p.withColumn("j", j).withColumn("i", F.expr("p - j * (j - 1) div 2"))
    p = p.withColumn("j", F.col("j") + F.when(F.col("i") < 0, -1).when(F.col("i") >= F.col("j"), 1).otherwise(0))
    return p.select(*group, F.expr("p - j * (j - 1) div 2").alias("i"), "j")


def places(samples: DataFrame, group: list[str], key: str) -> DataFrame:
    """group, key, i: the place from 0 of each sample in its group by key; no task holds more than its range of the samples."""
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(samples.select(*group, key).repartitionByRange(parts, *group, key).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy(*group, "range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    start = start.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("range").alias("range_"), "start")
    own = F.row_number().over(Window.partitionBy("range", *group).orderBy(key))
    same = F.col("range") == F.col("range_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_"))
    return ranged.withColumn("own", own).join(start, same).select(*group, key, (F.col("start") + F.col("own") - 1).alias("i"))


def composite(samples: DataFrame, group: list[str], key: str, vectors: DataFrame | None = None) -> DataFrame:
    """group, n, the mean similarities and the composite (0 diverse, 1 uniform).

    samples: group, key, code. n and the entropy are of all samples; pairs beyond PAIRS are drawn by key
    from all pairs of all samples; vectors (group, mean) gives the mean cosine where there is one, else 0.
    """
    # Keys alone are numbered; the samples of the drawn places alone are parsed.
    drawn = cut_lineage(drawn_pairs(samples.groupBy(*group).agg(F.count("*").alias("n")), group))
    small = F.broadcast if drawn.count() <= BROADCAST_ROWS // 2 else (lambda x: x)
    ends = drawn.select(*group, "i").union(drawn.select(*group, F.col("j").alias("i"))).distinct()
    place = cut_lineage(places(samples, group, key).join(small(ends), [*group, "i"]))
    f = syntax.with_features(samples.join(small(place), [*group, key])).select(
        *group, "i", F.array_distinct(tx.ngrams(tx.tokens(F.col("code"), tx.LEGACY_TOKENS), 3)).alias("g"),
        syntax.fingerprint_words(F.col("ast.fingerprint")).alias("s"), F.col("ast.names").alias("n"),
    )
    pairs = drawn
    for x, at in (("1", "i"), ("2", "j")):
        pairs = pairs.join(f.select(*group, F.col("i").alias(at), *[F.col(c).alias(f"{c}{x}") for c in ("g", "s", "n")]), [*group, at])
    sims = pairs.groupBy(*group).agg(F.avg(tx.jaccard(F.col("g1"), F.col("g2"))).alias("ngram"), F.avg(tx.jaccard(F.col("s1"), F.col("s2"))).alias("ast"), F.avg(tx.jaccard(F.col("n1"), F.col("n2"))).alias("naming"))
    ent = diversity(counts(syntax.with_patterns(samples), group, "p"), group).select(*group, F.col("n").alias("n_samples"), "legacy_entropy")
    out = ent.join(sims, group, "left")
    out = out.join(vectors.select(*group, F.col("mean").alias("vector")), group, "left") if vectors is not None else out.withColumn("vector", F.lit(0.0))
    out = out.fillna(0.0, ["ngram", "ast", "naming", "vector"])
    pattern = 1 - F.least(F.col("legacy_entropy") / 3, F.lit(1.0))
    score = sum((w * F.col(c) for c, w in WEIGHTS.items() if c != "pattern"), WEIGHTS["pattern"] * pattern)
    return out.withColumn("score", F.when(F.col("n_samples") < 2, 0.0).otherwise(score))
