"""Effective numbers by prompt, kernel and pool, and their paired differences from the human pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .inference import bootstrap_mean
from .kernels import pool_scores

GROUP = ["prompt_id", "pool", "model"]


def scores(pooled: DataFrame, kernels: dict[str, tuple[str, str]], boot: int = 0) -> DataFrame:
    """kernel, prompt_id, pool, model, n, score, normalised, lo, hi. kernels: name -> (column of items, kernel of `KERNELS`)."""
    each = [pool_scores(pooled, GROUP, item, kernel, boot=boot).select(F.lit(name).alias("kernel"), *GROUP, "n", "score", "normalised", "lo", "hi") for name, (item, kernel) in kernels.items()]
    return reduce(DataFrame.unionByName, each)


def by_pool(scored: DataFrame) -> DataFrame:
    """One row for each kernel, prompt and pool; of the pools within models the mean over models, with their 2.5 and 97.5 percentiles."""
    # A pool across models has one row, which the same sums leave as it is: the scores are made once.
    p = F.percentile("score", F.array(F.lit(0.025), F.lit(0.975)))
    own = F.array(F.max("lo"), F.max("hi"))
    one = scored.groupBy("kernel", "prompt_id", "pool").agg(F.sum("n").alias("n"), F.avg("score").alias("score"), F.avg("normalised").alias("normalised"), p.alias("p"), own.alias("own"))
    p = F.when(F.col("pool") == "intra", F.col("p")).otherwise(F.col("own"))
    return one.select("kernel", "prompt_id", "pool", "n", "score", "normalised", F.get(p, F.lit(0)).alias("lo"), F.get(p, F.lit(1)).alias("hi"))


def deltas(summary: DataFrame, n_kernels: int, b: int = 200) -> DataFrame:
    """kernel, pool (inter, intra), measure (raw, normalised), n, mean, lo, hi, p: the pool less the human one.

    Only prompts that have all three pools under every kernel are paired.
    """
    s = summary.filter("pool in ('inter', 'intra', 'human')")
    s = s.withColumn("k", F.count("*").over(Window.partitionBy("prompt_id"))).filter(F.col("k") == 3 * n_kernels)
    long = s.select("kernel", "prompt_id", "pool", F.explode(F.create_map(F.lit("raw"), "score", F.lit("normalised"), "normalised")).alias("measure", "v"))
    wide = long.groupBy("kernel", "prompt_id", "measure").pivot("pool", ["inter", "intra", "human"]).agg(F.first("v"))
    d = wide.select("kernel", "prompt_id", "measure", F.explode(F.create_map(F.lit("inter"), F.col("inter") - F.col("human"), F.lit("intra"), F.col("intra") - F.col("human"))).alias("pool", "delta"))
    return bootstrap_mean(d, ["kernel", "pool", "measure"], "prompt_id", "delta", b)
