"""Pools of samples: within a model, across models, human, and a null pool from other prompts; all draws are seeded by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drawn

CAP, PER_MODEL = 60, 4


def ranked(df: DataFrame, part: list[str], key: str, seed: str, name: str = "rn") -> DataFrame:
    order = Window.partitionBy(*part).orderBy(drawn(F.lit(seed), F.col(key).cast("string")), key)
    return df.withColumn(name, F.row_number().over(order).cast("long"))


def inter(df: DataFrame, key: str, per_model: int = PER_MODEL, cap: int = CAP) -> DataFrame:
    """per_model samples of each model of a prompt, cap in all."""
    few = ranked(df, ["prompt_id", "model_display"], key, "inter").filter(F.col("rn") <= per_model).drop("rn")
    return ranked(few, ["prompt_id"], key, "cap").filter(F.col("rn") <= cap).drop("rn").withColumn("pool", F.lit("inter"))


def intra(df: DataFrame, key: str, cap: int = CAP) -> DataFrame:
    return ranked(df, ["prompt_id", "model_display"], key, "intra").filter(F.col("rn") <= cap).drop("rn").withColumn("pool", F.lit("intra"))


def null_pool(df: DataFrame, sizes: DataFrame, key: str, cap: int = CAP) -> DataFrame:
    """For each prompt as many samples of other prompts as its inter pool has (sizes: prompt_id, n), least draws first.

    Draws do not depend on the prompt they are made for, so the first rows over all prompts are the
    same for each: 2 * cap rows are broadcast, whatever the tables' sizes.
    """
    draw = drawn(F.lit("null"), F.col(key).cast("string"))
    first = ranked(df, ["prompt_id"], key, "null").filter(F.col("rn") <= cap).drop("rn").withColumnRenamed("prompt_id", "from_prompt")
    # No prompt has more than cap rows of these, so the first 2 * cap of all hold cap of other prompts for each.
    first = first.orderBy(draw, key).limit(2 * cap)
    pairs = sizes.join(F.broadcast(first), F.col("prompt_id") != F.col("from_prompt"))
    order = Window.partitionBy("prompt_id").orderBy(draw, key)
    return pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= F.least("n", F.lit(cap))).drop("rn", "n").withColumn("pool", F.lit("null"))


def build(df: DataFrame, human: DataFrame, key: str, per_model: int = PER_MODEL, cap: int = CAP) -> DataFrame:
    """prompt_id, pool, model (of intra pools), key of all four pools in long form."""
    a = inter(df, key, per_model, cap)
    sizes = a.groupBy("prompt_id").agg(F.count("*").alias("n"))
    parts = [
        a.select("prompt_id", "pool", F.lit(None).cast("string").alias("model"), key),
        intra(df, key, cap).select("prompt_id", "pool", F.col("model_display").alias("model"), key),
        ranked(human, ["prompt_id"], key, "human").filter(F.col("rn") <= cap).select("prompt_id", F.lit("human").alias("pool"), F.lit(None).cast("string").alias("model"), key),
        null_pool(df, sizes, key, cap).select("prompt_id", "pool", F.lit(None).cast("string").alias("model"), key),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
