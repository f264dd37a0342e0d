"""Text, vector, pool and inference queries over documents, embeddings, events and the golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import inference, kernels, matching, pools, stats
from ..sources import fixtures as fx
from .registry import query, table


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


_TOK, _LEG = "[A-Za-z_][\\p{L}\\p{N}_]*|\\p{Nd}+|[^\\s\\p{L}\\p{N}_]", "[a-zA-Z_][\\p{L}\\p{N}_]*|[^\\s\\p{L}\\p{N}_]"


def _pairs_sql(pattern: str, tail: str) -> str:
    return f"""with {fx.TEXT_SQL}, t as (select *, regexp_extract_all(text, '{pattern}') as k from docs),
g as (select *, case when len(k) < 3 then [] else list_distinct(list_transform(range(1, len(k) - 1), lambda i: hash(k[i], k[i + 1], k[i + 2]))) end as g from t),
p as (select a.prompt_id, a.model_display, a.model_family as fa, b.model_family as fb, case when len(a.g) + len(b.g) = 0 then 1.0 else len(list_intersect(a.g, b.g))::double / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) end as j
  {tail}"""


_WITHIN = "from g a join g b on a.prompt_id = b.prompt_id and a.model_display = b.model_display and a.doc_id < b.doc_id) select prompt_id, model_display, count(*) as n_pairs, round(avg(j), 6) as mean_j from p group by 1, 2"


def _within(spark, d, pattern):
    p = kernels.mean_pair_text_jaccard(fx.text_samples(spark, d), ["prompt_id", "model_display"], "text", kernels.token_gram_sets, lambda c: kernels.token_lines(c, pattern))
    return p.select("prompt_id", "model_display", "n_pairs", r6("mean", "mean_j"))


@query(_pairs_sql(_TOK, _WITHIN))
def token_trigram_jaccard(spark, d):
    """Mean trigram Jaccard of all pairs of each (language, source) pool."""
    return _within(spark, d, tx.TOKENS)


@query(_pairs_sql(_LEG, _WITHIN))
def legacy_ngram_jaccard(spark, d):
    return _within(spark, d, tx.LEGACY_TOKENS)


@query(_pairs_sql(_TOK, """from g a join g b on a.prompt_id = b.prompt_id and a.model_display < b.model_display where a.sample_index = 0 and b.sample_index = 0)
select prompt_id, fa = fb as within, count(*) as n_pairs, round(avg(j), 6) as mean, round(stddev_pop(j), 6) as sd from p group by 1, 2"""))
def family_clustering(spark, d):
    """First samples of all models: similarity inside and across model families."""
    s = kernels.gram_sets(fx.text_samples(spark, d).filter("sample_index = 0"), "text")
    p = kernels.pair_jaccard(s, ["prompt_id"], "model_display", ["model_family"])
    return p.groupBy("prompt_id", (F.col("model_family_a") == F.col("model_family_b")).alias("within")).agg(F.count("*").alias("n_pairs"), r6(F.avg("j"), "mean"), r6(F.stddev_pop("j"), "sd"))


@query("""with t as (select lang, text, unnest(range(1, length(text) - 1)) as i from documents where length(text) >= 3), c as (select lang, substr(text, i, 3) as gram, count(*) as c from t group by 1, 2),
r as (select *, row_number() over (partition by lang order by c desc, gram) as rank from c) select lang, gram, c, rank from r where rank <= 20""")
def char_ngram_counts(spark, d):
    c = kernels.char_trigram_counts(table(spark, d, "documents"), "lang", "text").groupBy("lang", F.col("gram").alias("label")).agg(F.sum("c").alias("c"))
    return stats.top_k(c, ["lang"], 20).select("lang", F.col("label").alias("gram"), "c", "rank")


@query("with c as (select lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, count(*) as c from documents group by 1, 2), n as (select lang, sum(c) as n, sum(c * (c - 1)) as same, count(*) as n_unique from c group by 1) select lang, n::bigint as n, n_unique, round(case when n < 2 then 0 else same / (n * (n - 1)) end, 8) as rate from n")
def exact_match_rate(spark, d):
    c = stats.counts(table(spark, d, "documents").select("lang", tx.strip(F.col("text")).alias("t")), ["lang"], "t")
    return stats.diversity(c, ["lang"]).select("lang", "n", F.col("k").alias("n_unique"), F.round("match_rate", 8).alias("rate"))


@query(f"""with {fx.TEXT_SQL}, c as (select temperature, prompt_id, text, count(*) as c from docs group by 1, 2, 3), r as (select temperature, prompt_id, sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) as rate from c group by 1, 2 having sum(c) > 1)
select temperature, round(avg(rate), 8) as mean_rate, count(*) as n_prompts from r group by 1""")
def temperature_effect(spark, d):
    c = stats.counts(fx.text_samples(spark, d), ["temperature", "prompt_id"], "text")
    return stats.diversity(c, ["temperature", "prompt_id"]).filter("n > 1").groupBy("temperature").agg(F.round(F.avg("match_rate"), 8).alias("mean_rate"), F.count("*").alias("n_prompts"))


@query(f"""with {fx.TEXT_SQL}, f as (select distinct model_family as x from docs), k as (select prompt_id, x as without_family, text from docs join f on model_family <> x union all select prompt_id, null, text from docs),
c as (select prompt_id, without_family, text, count(*) as c from k group by 1, 2, 3) select prompt_id, without_family, sum(c)::bigint as n, round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 8) as match_rate from c group by 1, 2""")
def family_ablation(spark, d):
    """Match rate without each family in turn, from counts; nothing is repeated per family."""
    s = fx.text_samples(spark, d)
    c = s.groupBy("prompt_id", F.col("model_family").alias("without_family"), F.xxhash64("text").alias("label")).agg(F.count("*").alias("c"))
    return inference.leave_one_out_match(c, ["prompt_id"], "without_family").select("prompt_id", "without_family", "n", F.round("match_rate", 8).alias("match_rate"))


_UNIT = "unit as (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings), u as (select vec_id, label, unnest(embedding)::double / norm as x, generate_subscripts(embedding, 1) as i from unit)"


@query(f"with {_UNIT}, p as (select a.label, a.vec_id as a, b.vec_id as b, sum(a.x * b.x) as c from u a join u b on a.label = b.label and a.i = b.i and a.vec_id < b.vec_id group by 1, 2, 3) select label, (select count(*) from embeddings e where e.label = p.label) as n, round(avg(c), 6) as mean from p group by 1")
def embedding_mean_pairwise(spark, d):
    return kernels.mean_pair_cosine(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "n", r6("mean"))


@query("with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings), c as (select vec_id, label, i, x - avg(x) over (partition by label, i) as x from e) select vec_id, label, round(sqrt(sum(x * x)), 5) as norm from c group by 1, 2")
def embedding_center(spark, d):
    c = kernels.centred(table(spark, d, "embeddings"), "vec_id", ["label"], "embedding")
    return c.groupBy("vec_id", "label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 5).alias("norm"))


@query()
def embedding_all_but_top(spark, d):
    e = kernels.all_but_top(table(spark, d, "embeddings"), "embedding", 1)
    return e.select("vec_id", "label", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"))


@query("""with b as (select p_type, avg(p_size) as ms, stddev_pop(p_size) as ss, avg(p_retailprice) as mp, stddev_pop(p_retailprice) as sp from part group by 1),
z as (select p.p_type, p_partkey, case when ss > 0 then (p_size - ms) / ss else 0 end as a, case when sp > 0 then (p_retailprice - mp) / sp else 0 end as b from part p join b using (p_type)),
n as (select *, sqrt(a * a + b * b) as r from z), u as (select p_type, a / r as a, b / r as b from n where r > 0)
select p_type, count(*) as n, round((sum(a) * sum(a) + sum(b) * sum(b) - sum(a * a + b * b)) / (count(*) * (count(*) - 1.0)), 6) as mean from u group by 1""")
def feature_cosine_mean(spark, d):
    z = kernels.standardised(table(spark, d, "part").select("p_type", F.col("p_size").cast("double").alias("s"), "p_retailprice"), ["p_type"], ["s", "p_retailprice"])
    z = z.filter("s <> 0 or p_retailprice <> 0").withColumn("v", F.array("s", "p_retailprice"))
    return kernels.mean_pair_cosine(z, ["p_type"], "v").select("p_type", "n", r6("mean"))


_GRAMS = """words as (select prompt_id, model_display, doc_id, ' ' || unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) || ' ' as w from docs),
sized as (select *, unnest([3, 4, 5]) as n from words), grams as (select prompt_id, model_display, doc_id, substr(w, unnest(range(1, length(w) - n + 2)), n) as term from sized where length(w) >= n)"""
_WEIGHTS = """tf as (select prompt_id, model_display, doc_id, term, count(*) as tf from grams group by 1, 2, 3, 4), n as (select prompt_id, model_display, count(*) as n from docs group by 1, 2),
f as (select prompt_id, model_display, term, count(*) as df from tf group by 1, 2, 3), raw as (select tf.*, (1 + ln(tf)) * (ln((1.0 + n.n) / (1 + f.df)) + 1) as x from tf join f using (prompt_id, model_display, term) join n using (prompt_id, model_display)),
w as (select prompt_id, model_display, doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) as w from raw)"""


@query(f"""with {fx.TEXT_SQL}, {_GRAMS}, {_WEIGHTS}, s as (select prompt_id, model_display, term, sum(w) as s, sum(w * w) as own from w group by 1, 2, 3)
select prompt_id, model_display, max(n.n) as n, round(sum(s * s - own) / max(n.n * (n.n - 1)), 6) as mean from s join n using (prompt_id, model_display) where n.n > 1 group by 1, 2""")
def tfidf_char_cosine(spark, d):
    """Mean cosine of character n-gram TF-IDF rows of each pool, without forming a pair."""
    g = ["prompt_id", "model_display"]
    return kernels.mean_pair_tfidf(fx.text_samples(spark, d), g, "doc_id", "text").select(*g, "n", r6("mean"))


def _nearest(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", "text")
    return matching.nearest(b, table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query("""with every as (select 'q' || item_id as key, text from benchmark union all select 't' || doc_id, text from documents),
terms as (select key, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)) as term from every), tf as (select key, term, count(*) as tf from terms group by 1, 2),
f as (select term, count(*) as df from tf group by 1), raw as (select key, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from every)) / (1 + df)) + 1) as x from tf join f using (term)),
w as (select key, term, x / sqrt(sum(x * x) over (partition by key)) as w from raw),
s as (select a.key[2:]::bigint as item_id, b.key[2:]::bigint as doc_id, round(sum(a.w * b.w), 6) as similarity from w a join w b using (term) where a.key[1] = 'q' and b.key[1] = 't' group by 1, 2),
r as (select *, row_number() over (partition by item_id order by similarity desc, doc_id) as i from s) select item_id, doc_id, similarity from r where i = 1""")
def tfidf_word_nearest(spark, d):
    return _nearest(spark, d)


@query()
def greedy_top_matches(spark, d):
    n = _nearest(spark, d).join(table(spark, d, "benchmark"), "item_id")
    m = n.select(F.col("item_id").alias("match_id"), F.col("doc_id").alias("problem_id"), F.col("text").alias("prompt"), "similarity", (F.col("item_id") % 40 + 1).alias("n_solutions"))
    return matching.greedy(m, 50, 0.05, 5).withColumn("rank", F.round("rank", 6))


_MUST, _ANY = ["the"], ["license", "token", "and the", "idiot"]


@query("with n as (select doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') as t from documents), h as (select doc_id, t, list_filter([" + ", ".join(f"case when contains(t, '{k}') then '{k}' end" for k in _ANY) + "], lambda x: x is not null) as h from n) select doc_id, array_to_string(h, ',') as hits from h where contains(t, 'the') and len(h) > 0")
def keyword_match(spark, d):
    h = table(spark, d, "documents").withColumn("h", tx.keyword_hits(F.col("text"), _MUST, _ANY)).filter("h is not null")
    return h.select("doc_id", F.array_join("h", ",").alias("hits"))


@query("with s as (select doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents), u as (select min(doc_id) as doc_id, lang, sha1(t) as h from s where length(t) between 200 and 3000 group by lang, h), r as (select *, row_number() over (partition by lang order by doc_id) as place from u) select lang, doc_id, h, place from r where place <= 25")
def keyword_quota(spark, d):
    """Distinct texts of a middle length, the first of each language up to a quota."""
    t = table(spark, d, "documents").withColumn("t", tx.strip(F.col("text"))).filter(F.length("t").between(200, 3000))
    u = t.groupBy("lang", F.sha1("t").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return matching.quota(u, ["lang"], "doc_id", 25).select("lang", "doc_id", "h", "place")


# --- pools ----------------------------------------------------------------------------------------

_DRAW = lambda seed, key: f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint"
POOLS_SQL = f"""with {fx.TEXT_SQL}, human as (select prompt_id, doc_id from docs join labels using (doc_id) where quality = 1),
few as (select prompt_id, doc_id from docs qualify row_number() over (partition by prompt_id, model_display order by {_DRAW('inter', 'doc_id')}, doc_id) <= 4),
inter as (select prompt_id, doc_id from few qualify row_number() over (partition by prompt_id order by {_DRAW('cap', 'doc_id')}, doc_id) <= 60),
sizes as (select prompt_id, count(*) as n from inter group by 1),
pools as (select prompt_id, 'inter' as pool, null as model, doc_id from inter
  union all select prompt_id, 'intra', model_display, doc_id from (select * from docs qualify row_number() over (partition by prompt_id, model_display order by {_DRAW('intra', 'doc_id')}, doc_id) <= 60)
  union all select prompt_id, 'human', null, doc_id from (select * from human qualify row_number() over (partition by prompt_id order by {_DRAW('human', 'doc_id')}, doc_id) <= 60)
  union all select prompt_id, 'null', null, doc_id from (select s.prompt_id, s.n, o.doc_id from sizes s join docs o on o.prompt_id <> s.prompt_id
    qualify row_number() over (partition by s.prompt_id order by {_DRAW('null', 'o.doc_id')}, o.doc_id) <= least(s.n, 60))) """


def _pools(spark, d) -> DataFrame:
    s = fx.text_samples(spark, d).select("doc_id", "prompt_id", "model_display")
    human = s.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "prompt_id")
    return pools.build(s, human, "doc_id")


@query(POOLS_SQL + "select * from pools")
def build_pools(spark, d):
    return _pools(spark, d)


def _pool_sets(spark, d) -> DataFrame:
    t = kernels.gram_sets(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "g")
    return _pools(spark, d).withColumn("model", F.coalesce("model", F.lit(""))).join(t, "doc_id")


@query()
def token_effective_size(spark, d):
    """Effective number of texts of every pool under the trigram kernel, with bootstrap intervals."""
    s = kernels.pool_scores(_pool_sets(spark, d), ["prompt_id", "pool", "model"], "g", "jaccard", boot=100)
    return s.select("prompt_id", "pool", "model", "n", *[r6(c) for c in ("score", "normalised", "lo", "hi")])


@query()
def ordering_test(spark, d):
    """Paired difference of normalised scores, inter less human, over prompts that have both."""
    s = kernels.pool_scores(_pool_sets(spark, d).filter("pool in ('inter', 'human')"), ["prompt_id", "pool"], "g", "jaccard")
    p = s.groupBy("prompt_id").pivot("pool", ["inter", "human"]).agg(F.first("normalised")).filter("inter is not null and human is not null")
    return inference.bootstrap_mean(p.select(F.lit("jaccard").alias("kernel"), "prompt_id", (F.col("inter") - F.col("human")).alias("delta")), ["kernel"], "prompt_id", "delta").select("kernel", "n", *[r6(c) for c in ("mean", "lo", "hi", "p")])


@query()
def cosine_effective_size(spark, d):
    e = pools.ranked(table(spark, d, "embeddings"), ["label"], "vec_id", "cap").filter("rn <= 60")
    return kernels.pool_scores(e, ["label"], "embedding", "cosine").select("label", "n", r6("score"), r6("normalised"))


@query()
def cosine_effective_size_whole(spark, d):
    """Effective number of every label's vectors, all of them, from one D x D sum a label."""
    return kernels.whole_cosine_scores(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "n", r6("score"), r6("normalised"))


_POISSON = "list_sum([(u >= c)::int for c in " + str(list(inference.POISSON)) + "])"
_BOOT = lambda values: f"""{values}, n as (select grp, count(*) as n, avg(v) as mean from v group by 1),
hashed as (select grp, v, part, md5('boot|' || grp || '|' || key || '|' || part) as h from (select *, unnest(range(0, 25)) as part from v)),
drawn as (select grp, v, part * 8 + k as rep, ('0x' || substr(h, (4 * k + 1)::int, 4))::bigint as u from (select *, unnest(range(0, 8)) as k from hashed)),
m as (select grp, rep, sum({_POISSON} * v) / sum({_POISSON}) as m from drawn group by 1, 2 having sum({_POISSON}) > 0), s as (select grp, list_sort(list(m)) as s from m group by 1)
select grp, n, round(mean, 6) as mean, round(s[(floor(0.025 * len(s)) + 1)::int], 6) as lo, round(s[greatest(floor(0.975 * len(s)), 1)::int], 6) as hi, round(case when mean < 0 then len(list_filter(s, lambda x: x >= 0))::double / len(s) else 1.0 end, 6) as p from n join s using (grp)"""  # noqa: E731


@query(_BOOT("with v as (select event_type as grp, user_id as key, avg(value) as v from events group by 1, 2)"))
def bootstrap_mean_ci(spark, d):
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("key")).agg(F.avg("value").alias("v"))
    return inference.bootstrap_mean(v, ["grp"], "key", "v").select("grp", "n", *[r6(c) for c in ("mean", "lo", "hi", "p")])


@query(_BOOT("with u as (select user_id as key, avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as b from events group by 1), v as (select 'click-view' as grp, key, a - b as v from u where a is not null and b is not null)"))
def paired_bootstrap_delta(spark, d):
    e = table(spark, d, "events")
    u = e.groupBy(F.col("user_id").alias("key")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")).filter("a is not null and b is not null")
    return inference.bootstrap_mean(u.select(F.lit("click-view").alias("grp"), "key", (F.col("a") - F.col("b")).alias("v")), ["grp"], "key", "v").select("grp", "n", *[r6(c) for c in ("mean", "lo", "hi", "p")])


@query("""with x as (select o_orderpriority as g, o_totalprice as y, (o_orderstatus = 'F')::int::double as a from orders), w as (select y - avg(y) over (partition by g) as y, a - avg(a) over (partition by g) as a from x) select 'a' as term, round(sum(a * y) / sum(a * a), 4) as slope from w""")
def mixed_effects_fe(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("a"))
    slope = inference.fixed_effects(x, "g", "y", ["a"])
    return spark.createDataFrame([(k, v) for k, v in slope.items()], "term string, slope double").withColumn("slope", F.round("slope", 4))


@query()
def mixed_effects_reml(spark, d):
    x = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("g"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("a"))
    return spark.createDataFrame([(k, v) for k, v in inference.random_intercept(x, "g", "y", ["a"]).items()], "term string, estimate double")


# --- golden cases -----------------------------------------------------------------------------------

_BRIDGE = fx.values(fx.BRIDGE, "bridge(prompt, token_vn, ast_vn, ct5p_vn, match_vuln, vuln_pct)")


def bridge(spark) -> DataFrame:
    return spark.createDataFrame(list(fx.BRIDGE), "prompt string, token_vn double, ast_vn double, ct5p_vn double, match_vuln double, vuln_pct double")


def _rho_sql(x: str, y: str) -> str:
    return f"""select '{x}' as x, '{y}' as y, count(*) as n, round(corr(rx, ry), 4) as rho, round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1.0)), 4) as rho_formula
from (select rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as rx, rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0 as ry from bridge where {x} is not null and {y} is not null)"""


_RHO = [(x, y) for y in ("match_vuln", "vuln_pct") for x in ("token_vn", "ct5p_vn")]


@query(f"with {_BRIDGE} " + " union all ".join(_rho_sql(x, y) for x, y in _RHO))
def spearman_bridge(spark, d):
    out = None
    for x, y in _RHO:
        one = stats.spearman(bridge(spark), x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", F.round("rho", 4).alias("rho"), F.round("rho_formula", 4).alias("rho_formula"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_BRIDGE} select round(avg(token_vn), 4) as token_vn, round(avg(ast_vn), 4) as ast_vn, round(avg(ct5p_vn), 4) as ct5p_vn, round(avg(match_vuln), 4) as match_vuln, count(match_vuln) as n_match, count(*) filter (match_vuln >= 78) as n_high from bridge")
def bridge_means(spark, d):
    a = bridge(spark).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("token_vn", "ast_vn", "ct5p_vn", "match_vuln")], F.count("match_vuln").alias("n_match"), F.count(F.when(F.col("match_vuln") >= 78, 1)).alias("n_high"))
    return a


@query(f"with {fx.TEXT_SQL}, k as (select * from docs where model_display not in ('src0', 'src1', 'src2')), c as (select prompt_id, text, count(*) as c from k group by 1, 2) select prompt_id, sum(c)::bigint as n, round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 8) as match_rate from c group by 1")
def subset_recompute(spark, d):
    s = fx.text_samples(spark, d).filter(~F.col("model_display").isin("src0", "src1", "src2"))
    return stats.diversity(stats.counts(s, ["prompt_id"], "text"), ["prompt_id"]).select("prompt_id", "n", F.round("match_rate", 8).alias("match_rate"))


@query("""with e as (select user_id, event_type, list((event_id % 7)::varchar) as g from events group by 1, 2), c as (select user_id, list_sort(list(list_sort(g))) as c from e group by 1)
select user_id, array_to_string(list_transform(c, lambda g: array_to_string(g, ',')), '|') as canonical from c""")
def canonical_outputs(spark, d):
    """Groups of strings in canonical order: a user's event numbers by type, whatever order they came in."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list((F.col("event_id") % 7).cast("string")).alias("g"))
    c = e.groupBy("user_id").agg(F.collect_list("g").alias("c"))
    return c.select("user_id", F.array_join(F.transform(tx.canonical_groups(F.col("c")), lambda g: F.array_join(g, ",")), "|").alias("canonical"))


@query("""with e as (select user_id, event_id, case when event_type = 'error' then 'ERR' else 'OK:' || (event_id % 3) end as r from events),
t as (select user_id % 10 as prompt, user_id, string_agg(r, ';' order by event_id) as trace, count(*) filter (r <> 'ERR') as ok from e group by 1, 2),
c as (select prompt, trace, count(*) as c from t where ok > 0 group by 1, 2), d as (select *, sum(c) over (partition by prompt) as n from c)
select prompt, max(n)::bigint as n, count(*) as clusters, round(exp(-sum(c / n * ln(c / n))), 6) as effective from d group by 1""")
def trace_effective_size(spark, d):
    """Effective number of behaviours among runs with a passing case; a trace is a user's outcomes in order."""
    events = table(spark, d, "events")
    e = events.select("user_id", "event_id", F.when(F.col("event_type") == "error", "ERR").otherwise(F.concat(F.lit("OK:"), (F.col("event_id") % 3).cast("string"))).alias("r"))
    t = e.groupBy((F.col("user_id") % 10).alias("prompt"), "user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "r"))).alias("s"))
    t = t.select("prompt", F.array_join(F.transform("s", lambda x: x["r"]), ";").alias("trace"), F.exists("s", lambda x: x["r"] != "ERR").alias("ok")).filter("ok")
    return stats.diversity(stats.counts(t, ["prompt"], "trace"), ["prompt"]).select("prompt", "n", F.col("k").alias("clusters"), r6("effective"))
