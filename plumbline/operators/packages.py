"""Imports against known names and registry snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def latest(registry: DataFrame, fetched: str = "fetched") -> DataFrame:
    """The last snapshot of each name."""
    rest = [c for c in registry.columns if c != "name"]
    return registry.groupBy("name").agg(F.max_by(F.struct(*rest), fetched).alias("r")).select("name", "r.*")


def exploded(samples: DataFrame) -> DataFrame:
    return samples.withColumn("package", F.explode("imports"))


def not_known(imports: DataFrame, names: list[str]) -> DataFrame:
    """Imports whose lower-cased name is in no list; the lists are fixed tables."""
    return imports.filter(~F.lower("package").isin(*names))


def resolved(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds hallucinated: neither the import's name nor its alias exists in the registry's last snapshot."""
    alias = F.create_map(*[F.lit(x) for kv in vocab.ALIASES.items() for x in kv])
    snap = latest(registry).select(F.col("name").alias("n_"), "exists")
    a = imports.withColumn("alias", F.try_element_at(alias, F.col("package")))
    one = a.join(snap.select(F.col("n_").alias("n1"), F.col("exists").alias("e1")), F.col("package") == F.col("n1"), "left")
    two = one.join(snap.select(F.col("n_").alias("n2"), F.col("exists").alias("e2")), F.col("alias") == F.col("n2"), "left")
    return two.withColumn("hallucinated", ~F.coalesce("e1", F.lit(False)) & ~F.coalesce("e2", F.lit(False))).drop("n1", "n2", "e1", "e2")


def recent(first_upload: Column, as_of: Column, days: int = 30) -> Column:
    return F.coalesce(F.date_diff(as_of.cast("date"), first_upload.cast("date")) < days, F.lit(False))


def recurrence(h: DataFrame, budget: str = "sample") -> DataFrame:
    """How steadily each hallucinated package comes back: always, now and then, once; by prompt."""
    n = h.groupBy("prompt_id").agg(F.count_distinct(budget).alias("n"))
    p = h.groupBy("prompt_id", "package").agg(F.count_distinct(budget).alias("k"))
    kind = F.when(F.col("k") >= F.col("n"), "deterministic").when(F.col("k") > 1, "stochastic").otherwise("once")
    return p.join(n, "prompt_id").withColumn("kind", kind)


def shared(h: DataFrame, k: int = 20) -> DataFrame:
    """Packages that two or more models make up for one prompt, widest first."""
    g = h.groupBy("prompt_id", "package").agg(F.sort_array(F.collect_set("model_display")).alias("models"), F.count("*").alias("c"))
    w = g.filter(F.size("models") > 1).withColumn("n_models", F.size("models").cast("long"))
    return w.orderBy(F.col("n_models").desc(), F.col("c").desc(), "prompt_id", "package").limit(k)


def last_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).filter("rn = 1").drop("rn")
