"""Nearest texts by TF-IDF and the greedy pick of distinct matches; keyword quotas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import BROADCAST_ROWS, cut_lineage


def word_terms(c):
    return F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda w: F.length(w) > 1)


def word_counts(df: DataFrame) -> DataFrame:
    """key (long), text -> key, term, tf: a row for each different word of a text, as its 64-bit hash, counted where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False)
            held = [np.unique(words[s:e], return_counts=True) for s, e in zip(at[:-1], at[1:], strict=True)]
            key = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(h[0]) for h in held])
            term, tf = (np.concatenate([np.zeros(0, np.int64), *[h[k] for h in held]]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(term), pa.array(tf.astype(np.int32))], names=["key", "term", "tf"])

    hashed = df.filter("key is not null and text is not null").select(F.col("key").cast("long").alias("key"), F.transform(word_terms(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    return hashed.mapInArrow(run, "key long, term long, tf int")


def _one_text_a_key(df: DataFrame) -> DataFrame:
    """The texts of a key that comes more than once, as one."""
    if not df.groupBy("key").count().filter("count > 1").limit(1).count():
        return df
    return df.groupBy("key").agg(F.array_join(F.collect_list("text"), " ").alias("text"))


#: Similarities are compared at six digits; a bound must be lower by more than that to leave a text out.
MARGIN = 2e-6
#: So many of a query's rarest words find the text whose similarity becomes the query's threshold.
PROBES = 2


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast where it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _weights(queries: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """key, term, w of the queries, and of the texts for the queries' words alone; the number of the queries' rows.

    Sublinear tf times smooth idf of one vocabulary over both, each text's whole row of length one. A word of
    one text alone needs no entry among the document frequencies, so the rest are mostly few enough to be broadcast; then
    a text's words never leave the task that reads them, and a text adds one number to the norms.
    """
    n = queries.count() + texts.count()
    sides = [word_counts(_one_text_a_key(x)) for x in (queries, texts)]
    f = cut_lineage(sides[0].unionByName(sides[1]).groupBy("term").agg(F.count("*").alias("df")).filter("df > 1"))
    n_terms = f.count()
    asked = sides[0].select("term").distinct()
    n_asked = asked.count()

    def rows(counts: DataFrame) -> DataFrame:
        x = counts.join(_small(f, n_terms), "term", "left")
        return x.select("key", "term", ((1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(1)))) + 1)).alias("x"))

    out = []
    for c, wanted in ((sides[0], sides[0]), (sides[1], sides[1].join(_small(asked, n_asked), "term", "left_semi"))):
        norm = cut_lineage(rows(c).groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
        w = rows(wanted).join(_small(norm, norm.count()), "key")
        out.append(cut_lineage(w.select("key", "term", (F.col("x") / F.col("norm")).alias("w"))))
    return out[0], out[1], out[0].count()


def _surviving(a: DataFrame, b: DataFrame, query_key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that may be a query's best, with the sum over its essential words, and the query's other words.

    a: query_key, term, wq, of n rows. b: t_key, term, wt. What is derived from few query rows is broadcast, so that b stays where it is.
    """
    words = b.groupBy("term").agg(F.max("wt").alias("top"), F.count("*").alias("df"))
    q = cut_lineage(a.join(words, "term").withColumn("reach", F.col("wq") * F.col("top")))
    rare = q.withColumn("i", F.row_number().over(Window.partitionBy(query_key).orderBy("df", "term"))).filter(F.col("i") <= PROBES)
    probed = b.join(_small(rare, n), "term").groupBy(query_key, "t_key").agg(F.sum(F.col("wq") * F.col("wt")).alias("s"))
    guess = probed.groupBy(query_key).agg(F.max_by("t_key", F.struct("s", -F.col("t_key"))).alias("t_key"))
    held = b.join(_small(guess.join(q, query_key), n), ["t_key", "term"]).groupBy(query_key).agg(F.sum(F.col("wq") * F.col("wt")).alias("least"))
    # Words by what they can add at most: those whose bounds together stay below the threshold find nothing on their own.
    upto = F.sum("reach").over(Window.partitionBy(query_key).orderBy("reach", "term").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut_lineage(q.join(held, query_key).withColumn("essential", upto >= F.col("least") - MARGIN))
    other = cut.filter("not essential")
    found = b.join(_small(cut.filter("essential"), n), "term").groupBy(query_key, "t_key").agg(F.sum(F.col("wq") * F.col("wt")).alias("part"))
    # What a query's essential words must reach, the other words at their bounds.
    floor = cut.groupBy(F.col(query_key).alias("_q")).agg((F.first("least") - F.coalesce(F.sum(F.when(~F.col("essential"), F.col("reach"))), F.lit(0.0)) - MARGIN).alias("floor"))
    bounded = found.join(_small(floor, n), F.col(query_key) == F.col("_q")).filter("part >= floor")
    return cut_lineage(bounded.select(query_key, "t_key", "part")), other.select(query_key, "term", "wq")


def nearest(queries: DataFrame, texts: DataFrame, query_key: str, text_key: str, counted: bool = False) -> DataFrame:
    """The most similar text of each query (columns key, text on both sides); ties at six digits go to the lesser key.

    One vocabulary over both. Each query's rarest words find one text, whose exact similarity is a
    threshold. Each word has an upper bound of what it can add, its weight times its greatest weight
    in any text; the frequent words whose bounds together stay below the threshold are never joined
    to find texts: a text with no other word in common cannot win. Found texts whose sum over
    the essential words, and the bound of the rest, reach the threshold get the rest from a join on text and word.
    So words that all texts have meet the surviving pairs alone. Exact: nothing is left out that could win or tie.
    Queries and texts without a word in common with the other side have no row. counted adds n_verified, the texts
    of each query whose similarity was completed.
    """
    a, b, n = _weights(queries.select(F.col(query_key).alias("key"), "text"), texts.select(F.col(text_key).alias("key"), "text"))
    a, b = a.select(F.col("key").alias(query_key), "term", F.col("w").alias("wq")), b.select(F.col("key").alias("t_key"), "term", F.col("w").alias("wt"))
    pairs, other = _surviving(a, b, query_key, n)
    kept = pairs.select("t_key").distinct()
    held = b.join(_small(kept, kept.count()), "t_key", "left_semi")
    rest = pairs.join(held, "t_key").join(_small(other, n), [query_key, "term"]).groupBy(F.col(query_key).alias("_q"), F.col("t_key").alias("_t")).agg(F.sum(F.col("wq") * F.col("wt")).alias("more"))
    whole = pairs.join(rest, (F.col(query_key) == F.col("_q")) & (F.col("t_key") == F.col("_t")), "left")
    sims = whole.select(query_key, "t_key", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("similarity"))
    best = sims.groupBy(query_key).agg(F.max(F.struct("similarity", (-F.col("t_key")).alias("k"))).alias("b"), F.count("*").alias("n_verified"))
    out = best.select(query_key, (-F.col("b.k")).alias(text_key), F.col("b.similarity").alias("similarity"), "n_verified")
    return out if counted else out.drop("n_verified")


def greedy(matches: DataFrame, top_n: int, min_similarity: float = 0.30, min_solutions: int = 15, keep: int | None = None) -> DataFrame:
    """Picks by similarity * ln(1 + solutions), each problem and each prompt head (120 characters) once.

    Columns: match_id, problem_id, prompt, similarity, n_solutions. A match that ranks first at both its ends is the
    one that a sequential pick would take before any rival, so all such matches are taken at once, the matches that
    share an end with them go, and the rest is judged again, until none is left. Rounds are few
    (the longest chain of rivals of falling rank) and each is two aggregates and two joins over what is left.
    Matches without a problem or a prompt are not picked. All others are candidates; a caller that gives `keep` has so many, the most similar.
    """
    rank = F.col("similarity") * F.log1p(F.col("n_solutions").cast("double"))
    m = matches.filter((F.col("similarity") >= min_similarity) & (F.col("n_solutions") >= min_solutions) & F.col("problem_id").isNotNull() & F.col("prompt").isNotNull()).withColumn("head", F.lower(F.substr("prompt", F.lit(1), F.lit(120)))).withColumn("rank", rank)
    # Of equal (problem, head) pairs only the first by rank can ever be picked.
    order = F.struct((-F.col("rank")).alias("r"), F.col("match_id").alias("m"))
    first = m.groupBy("problem_id", "head").agg(F.min_by(F.struct("match_id", "rank", "similarity", "n_solutions"), order).alias("b")).select("problem_id", "head", "b.*")
    if keep is not None:
        first = first.orderBy(F.col("similarity").desc(), F.col("n_solutions").desc(), "match_id").limit(keep)
    left = cut_lineage(first.select("match_id", "problem_id", "head", "rank", order.alias("o")))
    picked = None
    while left.limit(1).count():
        by = lambda end: left.groupBy(F.col(end).alias(f"{end}_")).agg(F.min("o").alias(f"{end}_best"))
        won = left.join(by("problem_id"), F.col("problem_id") == F.col("problem_id_")).join(by("head"), F.col("head") == F.col("head_"))
        won = won.filter((F.col("o") == F.col("problem_id_best")) & (F.col("o") == F.col("head_best"))).select("match_id", "problem_id", "head", "rank", "o").persist()
        picked = won if picked is None else picked.unionByName(won)
        rest = left.join(won.select("problem_id"), "problem_id", "left_anti").join(won.select("head"), "head", "left_anti").select("match_id", "problem_id", "head", "rank", "o")
        left = cut_lineage(rest)
    schema = "match_id long, problem_id long, rank double, place long"
    if picked is None:
        return matches.sparkSession.createDataFrame([], schema)
    top = picked.orderBy("o").limit(top_n)
    return top.select("match_id", "problem_id", "rank", F.row_number().over(Window.orderBy("o")).cast("long").alias("place"))


def quota(df: DataFrame, part: list[str], key: str, cap: int) -> DataFrame:
    """The first cap rows of each part in key order, after duplicates."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(key)).cast("long")).filter(F.col("place") <= cap)

