"""Statistics over the large tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .registry import query, table

_DIV = """with c as (select {g} as grp, {l} as label, count(*) as c from {t} group by 1, 2),
d as (select *, sum(c) over (partition by grp) as n, row_number() over (partition by grp order by c, label) as i, count(*) over (partition by grp) as k from c)
"""


def _div(t: str, g: str, label: str, select: str) -> str:
    return _DIV.format(t=t, g=g, l=label) + f"select grp, {select} from d group by grp"


def _stats(spark, d, t, g, label):
    return stats.diversity(stats.counts(table(spark, d, t).select(F.col(g).alias("grp"), F.col(label).alias("v")), ["grp"], "v"), ["grp"])


@query(_div("lineitem", "l_returnflag", "l_quantity", "round(sum(c / n * log2(n / c)), 6) as entropy"))
def shannon_entropy(spark, d):
    return _stats(spark, d, "lineitem", "l_returnflag", "l_quantity").select("grp", F.round("entropy", 6).alias("entropy"))


@query(_div("part", "p_type", "p_brand", "round(case when max(k) <= 1 then 0 else sum(c / n * log2(n / c)) / log2(max(k)) end, 6) as normalized"))
def normalized_entropy(spark, d):
    return _stats(spark, d, "part", "p_type", "p_brand").select("grp", F.round("normalized", 6).alias("normalized"))


@query(_div("orders", "o_orderstatus", "o_orderpriority", "round(case when max(n) < 2 then 0 else 1 - sum(c * (c - 1)) / max(n * (n - 1)) end, 6) as simpson"))
def simpson_diversity(spark, d):
    return _stats(spark, d, "orders", "o_orderstatus", "o_orderpriority").select("grp", F.round("simpson", 6).alias("simpson"))


@query(_div("lineitem", "l_linestatus", "l_suppkey", "round(max(c) / max(n), 6) as dominant"))
def dominant_ratio(spark, d):
    return _stats(spark, d, "lineitem", "l_linestatus", "l_suppkey").select("grp", F.round("dominant", 6).alias("dominant"))


@query(_div("lineitem", "l_returnflag", "l_partkey", "round(sum((2 * i - k - 1) * c) / (max(k) * max(n)), 6) as gini"))
def gini_coefficient(spark, d):
    return _stats(spark, d, "lineitem", "l_returnflag", "l_partkey").select("grp", F.round("gini", 6).alias("gini"))


@query(_div("lineitem", "l_returnflag", "l_linenumber", "round(exp(-sum(c / n * ln(c / n))), 6) as effective"))
def indicator_effective_size(spark, d):
    """The equality kernel's effective number of items, in closed form."""
    return _stats(spark, d, "lineitem", "l_returnflag", "l_linenumber").select("grp", F.round("effective", 6).alias("effective"))


@query("""with c as (select l_returnflag as grp, l_suppkey as label, count(*) as c from lineitem group by 1, 2),
r as (select *, row_number() over (partition by grp order by c desc, label) as rank from c) select grp, label, c, rank from r where rank <= 8""")
def most_common(spark, d):
    c = stats.counts(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_suppkey")
    return stats.top_k(c, ["grp"], 8).select("grp", "label", "c", "rank")


@query("""with c as (select o_orderstatus as grp, o_orderpriority as label, count(*) as c from orders group by 1, 2),
top as (select label from c group by label order by sum(c) desc, label limit 3),
s as (select grp, case when label in (select label from top) then label else 'other' end as label, sum(c) as c from c group by 1, 2)
select grp, label, c::bigint as c, round(c / sum(c) over (partition by grp), 6) as share from s""")
def top_labels_other_bucket(spark, d):
    c = stats.counts(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "grp"), ["grp"], "o_orderpriority")
    return stats.top_or_other(c, ["grp"], 3).select("grp", "label", "c", F.round("share", 6).alias("share"))


@query("""with r as (select *, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rx,
  rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as ry from lineitem)
select count(*) as n, round(corr(rx, ry), 6) as rho, round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) as rho_formula from r""")
def rank_correlation(spark, d):
    """Over every row of the table, ranked from counts of the distinct values."""
    c = stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return c.select("n", F.round("rho", 6).alias("rho"), F.round("rho_formula", 6).alias("rho_formula"))


@query("""with a as (select p_brand as grp, (avg(p_retailprice) - 1400) / 100 as z from part group by p_type, p_brand)
select grp, round(sum(z) / sqrt(count(*)), 6) as z from a group by grp""")
def stouffer_z(spark, d):
    a = table(spark, d, "part").groupBy("p_type", F.col("p_brand").alias("grp")).agg(((F.avg("p_retailprice") - 1400) / 100).alias("z"))
    return stats.stouffer(a, ["grp"], "z").select("grp", F.round("z", 6).alias("z"))


@query("""select * from (values (0.0, 1.0), (0.5, 0.617075), (1.0, 0.317311), (1.96, 0.049996), (3.0, 0.0027)) as t(z, p)""")
def two_sided_p(spark, d):
    t = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.96,), (3.0,)], "z double")
    return t.select(F.col("z").cast("decimal(3,2)").alias("z"), F.round(stats.normal_two_sided(F.col("z")), 6).cast("decimal(7,6)").alias("p"))
