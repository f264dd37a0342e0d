"""Categorical diversity, concentration, intervals and rank correlation: count first, then closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """group, label, c: one shuffle of partial counts; all statistics below start from these."""
    return df.groupBy(*group, F.col(label).alias("label")).agg(F.count("*").alias("c"))


def diversity(counted: DataFrame, group: list[str]) -> DataFrame:
    """Every count-based statistic of each group in one pass over its labels.

    entropy (bits), normalized, simpson, dominant, gini, effective (exponential of the natural
    entropy: what the eigenvalues of an equality kernel give), legacy_entropy (with 1e-10).
    """
    whole, rising = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("c", "label")
    p = F.col("c") / F.col("n")
    d = counted.withColumn("n", F.sum("c").over(whole)).withColumn("i", F.row_number().over(rising)).withColumn("k", F.count("*").over(whole))
    a = d.groupBy(*group).agg(
        F.max("n").alias("n"), F.max("k").alias("k"), F.max("c").alias("top"),
        F.sum(p * F.log2(1 / p)).alias("entropy"), (-F.sum(p * F.log2(p + 1e-10))).alias("legacy_entropy"),
        F.exp(-F.sum(p * F.log(p))).alias("effective"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"),
        F.sum((2 * F.col("i") - F.col("k") - 1) * F.col("c")).alias("spread"),
    )
    n = F.col("n")
    return a.select(
        *group, "n", "k", "entropy", "legacy_entropy", "effective",
        F.when(F.col("k") <= 1, 0.0).otherwise(F.col("entropy") / F.log2("k")).alias("normalized"),
        F.when(n < 2, 0.0).otherwise(1 - F.col("same") / F.when(n > 1, n * (n - 1))).alias("simpson"),
        (F.col("top") / n).alias("dominant"), (F.col("spread") / (F.col("k") * n)).alias("gini"),
        F.when(n < 2, 0.0).otherwise(F.col("same") / F.when(n > 1, n * (n - 1))).alias("match_rate"),
    )


def top_k(counted: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k most frequent labels of each group; ties go to the lesser label."""
    order = Window.partitionBy(*group).orderBy(F.col("c").desc(), "label")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def top_or_other(counted: DataFrame, group: list[str], k: int) -> DataFrame:
    """Shares of the k labels that are most frequent overall, the rest as `other`, within each group."""
    total = counted.groupBy("label").agg(F.sum("c").alias("t"))
    top = total.orderBy(F.col("t").desc(), "label").limit(k).select(F.col("label").alias("l"))
    named = counted.join(F.broadcast(top), F.col("label") == F.col("l"), "left").withColumn("label", F.coalesce("l", F.lit("other")))
    shares = named.groupBy(*group, "label").agg(F.sum("c").alias("c"))
    return shares.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(*group)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def counted_ranks(values: DataFrame, ranges: int = 64) -> DataFrame:
    """v, r: the tie-averaged rank of each value of the counts v, c; no task holds more than a range of the values.

    The cuts between ranges are approximate quantiles; where they lie does not change a rank.
    """
    v = F.col("v").cast("double")
    cuts = sorted(set(values.select(v.alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    ranged = values.withColumn("part", sum((F.when(v > q, 1).otherwise(0) for q in cuts), F.lit(0)))
    before = ranged.groupBy("part").agg(F.sum("c").alias("here"))
    before = before.select("part", (F.sum("here").over(Window.orderBy("part")) - F.col("here")).alias("before"))  # one row a range
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    return ranged.withColumn("upto", upto).join(F.broadcast(before), "part").select("v", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho (Pearson of tie-averaged ranks), rho_formula (1 - 6 sum d2 / n(n2-1)) over rows where both are known.

    From counts of the distinct pairs and values, so no task ranks them all.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    counted = pairs = both.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    for k in ("x", "y"):
        ranks = counted_ranks(counted.groupBy(F.col(k).alias("v")).agg(F.sum("c").alias("c"))).select(F.col("v").alias(k), F.col("r").alias(f"r{k}"))
        pairs = pairs.join(ranks, k)
    n = pairs.agg(F.sum("c").alias("n"))
    d = pairs.crossJoin(F.broadcast(n)).select("n", "c", (F.col("rx") - (F.col("n") + 1) / 2).alias("x"), (F.col("ry") - (F.col("n") + 1) / 2).alias("y"))
    total = lambda v: F.sum(F.col("c") * v)
    x_, y_ = F.col("x"), F.col("y")
    a = d.agg(F.sum("c").alias("n"), (total(x_ * y_) / F.sqrt(total(x_ * x_) * total(y_ * y_))).alias("rho"), total((x_ - y_) * (x_ - y_)).alias("d2"))
    size = F.col("n").cast("double")
    return a.select("n", "rho", (1 - 6 * F.col("d2") / (size * (size * size - 1))).alias("rho_formula"))


def normal_two_sided(z: Column) -> Column:
    """erfc(|z|/sqrt 2) by the Abramowitz-Stegun rational form 7.1.26; absolute error below 2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def stouffer(df: DataFrame, group: list[str], z: str) -> DataFrame:
    a = df.groupBy(*group).agg((F.sum(z) / F.sqrt(F.count(z))).alias("z"))
    return a.withColumn("p", normal_two_sided(F.col("z")))
