"""Further aggregates, windows and set operations over the samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import kernels, pools, scan, stats
from ..sources import fixtures as fx
from . import queries_code as qc
from . import sql_code as sc
from .registry import query, table

r6 = qc.r6


@query(sc.FEATURES_SQL + """, u as (select model_display as grp, unnest(imports) as label from code join features using (k)), c as (select grp, label, count(*) as c from u group by 1, 2),
d as (select *, sum(c) over (partition by grp) as n, row_number() over (partition by grp order by c, label) as i, count(*) over (partition by grp) as k from c)
select grp, count(*) as n_unique, round(sum(c / n * log2(n / c)), 6) as entropy, round(sum((2 * i - k - 1) * c) / (max(k) * max(n)), 6) as gini from d group by 1""")
def library_metrics(spark, d):
    u = qc.imported(spark, d).select(F.col("model_display").alias("grp"), F.explode("imports").alias("lib"))
    return stats.diversity(stats.counts(u, ["grp"], "lib"), ["grp"]).select("grp", F.col("k").alias("n_unique"), r6("entropy"), r6("gini"))


@query(sc.FEATURES_SQL + """, s as (select distinct c.model_display, c.k, f.imports as i from code c join features f using (k)),
p as (select a.model_display, case when len(a.i) + len(b.i) = 0 then 1.0 else len(list_intersect(a.i, b.i))::double / (len(a.i) + len(b.i) - len(list_intersect(a.i, b.i))) end as j from s a join s b on a.model_display = b.model_display and a.k < b.k)
select model_display, count(*) as n_pairs, round(avg(j), 6) as mean from p group by 1""")
def import_jaccard_mean(spark, d):
    """Mean Jaccard of import sets over all pairs of the samples of each model."""
    s = qc.imported(spark, d).select("model_display", F.transform("imports", lambda x: F.xxhash64(x)).alias("g"))
    return kernels.mean_pair_jaccard(s, ["model_display"]).select("model_display", "n_pairs", r6("mean"))


@query(sc.FEATURES_SQL + """, s as (select model_display, list_distinct(regexp_extract_all(f.code, '[a-zA-Z_]\\w{2,}')) as w from code c join features f using (k)), d as (select model_display, list_sort(w) as w, count(*) as c from s group by 1, 2),
n as (select model_display, sum(c) as n, sum(c * (c - 1)) as same from d group by 1),
p as (select a.model_display, sum(a.c * b.c * case when len(a.w) + len(b.w) = 0 then 1.0 else len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end) as t from d a join d b on a.model_display = b.model_display and a.w <> b.w group by 1)
select model_display, (n * (n - 1) / 2)::bigint as n_pairs, round((same + coalesce(t, 0)) / (n * (n - 1)), 6) as mean from n left join p using (model_display)""")
def naming_fallback_jaccard(spark, d):
    """Mean Jaccard of names, as a pattern finds them, over all pairs of the samples of each model."""
    s = fx.code_samples(spark, d).select("model_display", F.transform(tx.identifiers(F.col("code")), lambda x: F.xxhash64(x)).alias("g"))
    return kernels.mean_pair_jaccard(s, ["model_display"]).select("model_display", "n_pairs", r6("mean"))


_CAT = "case split_part(prompt_id, '-', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in vocab.CATEGORIES.items()) + " else 'other' end"


@query(sc.SCAN_SQL + f", p as (select {_CAT} as category, prompt_id, avg(vulnerable::int) as rate from scanned group by 1, 2) select category, count(*) as n_prompts, round(avg(rate), 6) as mean_rate from p group by rollup (category)")
def category_averages(spark, d):
    p = qc.scanned(spark, d).groupBy(tx.category(F.col("prompt_id")).alias("category"), "prompt_id").agg(F.avg(F.col("is_vulnerable").cast("int")).alias("rate"))
    return p.rollup("category").agg(F.count("*").alias("n_prompts"), r6(F.avg("rate"), "mean_rate"))


@query(sc.SCAN_SQL + ", m as (select model_display, prompt_id, avg(len(string_split(cwes, ',')) * (cwes <> '')::int) as n from scanned group by 1, 2) select model_display, count(*) as n_prompts, round(avg(n), 6) as mean_cwes from m group by 1")
def per_model_average(spark, d):
    m = qc.scanned(spark, d).groupBy("model_display", "prompt_id").agg(F.avg(F.size("cwe_set")).alias("n"))
    return m.groupBy("model_display").agg(F.count("*").alias("n_prompts"), r6(F.avg("n"), "mean_cwes"))


@query(sc.SCAN_SQL + ", t as (select max(temperature) as t from code) select prompt_id, count(*) as n from scanned, t where abs(temperature - t.t) <= 1e-6 group by 1")
def hottest_temperature(spark, d):
    """Samples at the highest temperature of the data."""
    s = fx.code_samples(spark, d)
    top = s.agg(F.max("temperature").alias("t"))
    return s.join(F.broadcast(top), F.abs(F.col("temperature") - F.col("t")) <= 1e-6).groupBy("prompt_id").agg(F.count("*").alias("n"))


@query(sc.SCAN_SQL + """, e as (select event_id, f.cwe, f.line, f.sink, 'regex' as detector, f.severity from code c join found f using (k)),
x as (select event_id, case when cwe = 'CWE-89' then 'CWE-89' else cwe end as cwe, line, sink, 'second' as detector, 5.5::double as severity from e where cwe in ('CWE-89', 'CWE-78')),
u as (select * from e union all select * from x union all select * from e)
select event_id, count(*) as n, count(distinct detector) as n_detectors, round(sum(severity), 6) as severity from (select distinct event_id, cwe, line, sink, detector, severity from u) group by 1""")
def merged_findings(spark, d):
    """Union of detectors' findings, one of each; here a second detector repeats part of the first and the first comes twice."""
    f = qc.scanned(spark, d).select("event_id", F.explode("findings").alias("f")).select("event_id", "f.cwe", "f.line", "f.sink", "f.detector", "f.severity")
    x = f.filter(F.col("cwe").isin("CWE-89", "CWE-78")).withColumns({"detector": F.lit("second"), "severity": F.lit(5.5)})
    m = scan.merge_findings(f, x, f, key=["event_id"])
    return m.groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("detector").alias("n_detectors"), r6(F.sum("severity"), "severity"))


@query("""select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as heading from events""")
def carried_heading(spark, d):
    """The last heading seen so far, as a line reader carries it."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("heading"))


@query(f"with {fx.CODE_SQL} select prompt_id, model_display, max(event_id) as event_id, arg_max(sha1(code), event_id) as code from code group by 1, 2")
def last_sample_per_model(spark, d):
    s = fx.code_samples(spark, d)
    return s.groupBy("prompt_id", "model_display").agg(F.max("event_id").alias("event_id"), F.max_by(F.sha1("code"), "event_id").alias("code"))


@query("""with t as (select doc_id, lang, source, text, unnest(range(1, length(text))) as i from documents where length(text) >= 2), c as (select lang, source, doc_id, substr(text, i, 2) as g, count(*) as c from t group by 1, 2, 3, 4),
n as (select lang, source, doc_id, sum(c) as n from c group by 1, 2, 3), s as (select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as common from c a join c b on a.lang = b.lang and a.source = b.source and a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
select p.lang, p.source, count(*) as n_pairs, round(avg(coalesce(common, 0) / (p.n + r.n - coalesce(common, 0))), 6) as mean from n p join n r on p.lang = r.lang and p.source = r.source and p.doc_id < r.doc_id left join s on s.a = p.doc_id and s.b = r.doc_id group by 1, 2""")
def multiset_jaccard(spark, d):
    """Mean multiset Jaccard of character pairs over all pairs of each pool: the n-th time that a gram stands is an item of its own."""
    t = table(spark, d, "documents").filter("length(text) >= 2")
    return kernels.mean_pair_text_jaccard(t, ["lang", "source"], "text", kernels.char_bag_sets).select("lang", "source", "n_pairs", r6("mean"))


@query(sc.SCAN_SQL + ", c as (select prompt_id, model_display, count(*) as n, count(distinct cwes) as sets from scanned where vulnerable group by 1, 2 having count(*) > 1), r as (select *, row_number() over (order by n desc, prompt_id, model_display) as i from c) select prompt_id, model_display, n, sets from r where i <= 10")
def top_prompts(spark, d):
    v = qc.scanned(spark, d).filter("is_vulnerable").groupBy("prompt_id", "model_display").agg(F.count("*").alias("n"), F.count_distinct(F.array_join("cwe_set", ",")).alias("sets")).filter("n > 1")
    return v.orderBy(F.col("n").desc(), "prompt_id", "model_display").limit(10)


@query()
def signature_effective_size(spark, d):
    """Effective number of signatures of each prompt under their Jaccard, on distinct signatures."""
    s = qc.scanned(spark, d).select("prompt_id", F.transform("pattern_signature", lambda x: F.concat(x["cwe"], F.lit("@"), x["sink"])).alias("g"))
    return kernels.pool_scores(s, ["prompt_id"], "g", "jaccard", boot=50).select("prompt_id", "n", *[r6(c) for c in ("score", "normalised", "lo", "hi")])


@query()
def temperature_sweep(spark, d):
    """Trigram effective sizes of capped pools by temperature: the temperature is one more group column."""
    s = pools.ranked(fx.text_samples(spark, d), ["prompt_id", "temperature"], "doc_id", "cap").filter(F.col("rn") <= pools.CAP)
    return kernels.pool_scores(kernels.gram_sets(s, "text"), ["prompt_id", "temperature"], "g", "jaccard").select("prompt_id", "temperature", "n", r6("score"), r6("normalised"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def hourly_events(spark, d):
    """Event counts by hour and type: the batch form of the windowed stream."""
    from ..streaming.incremental import windowed_counts

    w = windowed_counts(table(spark, d, "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("mean"))


@query("""with o as (select *, lag(ts) over (partition by user_id order by ts) as before from events where ts is not null),
s as (select *, sum(case when before is null or ts > before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, max(ts) as last, count(*) as n, round(sum(value), 6) as total from s group by user_id, k""")
def user_sessions(spark, d):
    """Sessions of each user's events, 30 minutes apart at most: the batch form of the session stream."""
    from ..streaming.incremental import once, sessions

    w = sessions(once(table(spark, d, "events")))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n", r6("total"))


@query()
def s2_metrics(spark, d):
    """Homogeneity of signatures by prompt, over all samples and over the vulnerable ones, in one row."""
    m = scan.s2_metrics(qc.scanned(spark, d), ["prompt_id"])
    top = F.array_join(F.transform("top", lambda t: F.concat(t["label"], F.lit(" x"), t["c"].cast("string"))), " | ")
    return m.select("prompt_id", "mode", "n", "n_unique", "n_unique_cwe", *[r6(c) for c in ("match_rate", "indicator", "indicator_norm", "jaccard", "jaccard_norm", "cwe", "cwe_norm")], top.alias("top"))


@query("""with b as (select p_type, avg(p_size) as ms, stddev_pop(p_size) as ss, avg(p_retailprice) as mp, stddev_pop(p_retailprice) as sp from part group by 1),
z as (select p_type, p_partkey, case when ss > 0 then (p_size - ms) / ss else 0 end as a, case when sp > 0 then (p_retailprice - mp) / sp else 0 end as b from part join b using (p_type)),
u as (select p_type, p_partkey, a / sqrt(a * a + b * b) as a, b / sqrt(a * a + b * b) as b from z where a <> 0 or b <> 0)
select x.p_type, count(*) as n_pairs, round(median(x.a * y.a + x.b * y.b), 6) as median from u x join u y on x.p_type = y.p_type and x.p_partkey < y.p_partkey group by 1""")
def feature_cosine_median(spark, d):
    """Median cosine of standardised features over all pairs of each group."""
    p = table(spark, d, "part").select("p_type", "p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    z = kernels.standardised(p, ["p_type"], ["s", "r"]).filter("s <> 0 or r <> 0")
    u = z.select("p_type", "p_partkey", kernels.unit(F.array("s", "r")).alias("u"))
    return kernels.median_pair_cosine_plane(u, ["p_type"], "u").select("p_type", "n_pairs", r6("median"))
