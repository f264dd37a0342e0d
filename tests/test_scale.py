"""Operators that never form all pairs or gather a group: against brute force."""

import collections
import itertools
import math
import random

import numpy as np


def test_median_over_all_pairs(spark):
    from plumbline.operators.kernels import median_pair_cosine

    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 83), ("b", 40), ("two", 2), ("one", 1), ("same", 9), (None, 4)):
        x = rng.normal(size=(n, 3))
        x = np.repeat(x[:1], n, 0) if g == "same" else x
        rows += [(g, i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    rows += [("zero", i, [0.0, 0.0, 0.0]) for i in range(3)] + [("a", 1000, None)]
    df = spark.createDataFrame(rows, "grp string, k long, u array<double>")
    for block, bins in ((512, 2048), (11, 7)):  # few bins: many passes
        got = {r.grp: (r.n_pairs, r["median"]) for r in median_pair_cosine(df, ["grp"], "k", "u", block, bins).collect()}
        assert set(got) == {"a", "b", "two", "same", "zero"}
        for g in got:
            u = [np.array(v) for h, _, v in rows if h == g and v is not None]
            dots = [float(x @ y) for x, y in itertools.combinations(u, 2)]
            assert got[g][0] == len(dots) and abs(got[g][1] - np.median(dots)) < 1e-12


def brute_nearest(queries, texts):
    words = lambda t: [w for w in __import__("re").split(r"[^\w]+", (t or "").lower()) if len(w) > 1]
    every = [words(t) for _, t in queries + texts]
    df = collections.Counter(w for ws in every for w in set(ws))

    def row(ws):
        x = {w: (1 + math.log(c)) * (math.log((1 + len(every)) / (1 + df[w])) + 1) for w, c in collections.Counter(ws).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    out = {}
    t_rows = [(k, row(words(t))) for k, t in texts]
    for k, t in queries:
        q = row(words(t))
        sims = [(-round(sum(q[w] * x[w] for w in q.keys() & x.keys()), 6), j) for j, x in t_rows if q.keys() & x.keys()]
        if sims:
            out[k] = (min(sims)[1], -min(sims)[0])
    return out


def test_nearest_leaves_out_only_what_cannot_win(spark):
    from plumbline.operators.matching import nearest

    rnd = random.Random(3)
    frequent, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rnd.choices(frequent, k=8) + rnd.sample(rare, 6))
    texts = [(i, text()) for i in range(300)]
    texts += [(300 + i, t) for i, (_, t) in enumerate(texts[:20])] + [(900, ""), (901, None), (902, "the the of")]  # copies: ties
    queries = [(i, texts[i * 7][1] if i % 2 else text()) for i in range(40)] + [(50, "the of and"), (51, ""), (52, None), (53, "unseen words"), (54, "the")]
    q, t = spark.createDataFrame(queries, "q long, text string"), spark.createDataFrame(texts, "t long, text string")
    got = nearest(q, t, "q", "t", counted=True).collect()
    want = brute_nearest(queries, texts)
    assert {r.q: r.t for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.similarity - want[r.q][1]) < 1.5e-6 for r in got)
    # Nearly every pair shares a frequent word; few are verified.
    assert sum(r.n_verified for r in got if r.q < 50) < 0.2 * 40 * len(texts)
    assert nearest(q, t.limit(0), "q", "t").count() == 0 and nearest(q.limit(0), t, "q", "t").count() == 0


def test_greedy_takes_any_number_of_candidates(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.matching import greedy

    # The least similar of 6,001 candidates has by far the most solutions.
    m = spark.range(6001).select(F.col("id").alias("match_id"), F.col("id").alias("problem_id"), F.concat(F.lit("head "), F.col("id")).alias("prompt"))
    m = m.withColumn("similarity", F.when(F.col("match_id") == 6000, 0.4).otherwise(0.9)).withColumn("n_solutions", F.when(F.col("match_id") == 6000, 100_000).otherwise(20))
    got = greedy(m, 6001).orderBy("place").collect()
    assert [r.match_id for r in got] == [6000, *range(6000)]


def test_reml_is_the_dense_likelihood(spark):
    from plumbline.operators.inference import fixed_effects, random_intercept

    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(1 + 2 * x + e + rng.normal() * 0.7)) for g in range(25) for e in [float(rng.normal())] for x in rng.normal(size=3 + g % 4)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = random_intercept(df.repartition(3), "g", "y", ["x"])
    g, x, y = np.array([r[0] for r in rows]), np.array([[1, r[1]] for r in rows]), np.array([r[2] for r in rows])

    def dense(ratio):
        v = np.eye(len(y)) + ratio * (g[:, None] == g[None, :])
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        beta = np.linalg.solve(a, x.T @ w @ y)
        s2 = (y - x @ beta) @ w @ (y - x @ beta) / (len(y) - 2)
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + (len(y) - 2) * np.log(s2)), beta, s2

    ratio = got["group_variance"] / got["residual"]
    like, beta, s2 = dense(ratio)
    assert abs(beta[0] - got["intercept"]) < 1e-8 and abs(beta[1] - got["x"]) < 1e-8 and abs(s2 - got["residual"]) < 1e-8 and got["fallback"] == 0
    assert all(like >= dense(r)[0] for r in ratio * np.array([0.5, 0.9, 0.99, 1.01, 1.1, 2]))
    # A slope variable that never changes beside an intercept: the fixed effects say so too.
    flat = spark.createDataFrame([(r[0], 1.0, r[1], r[2]) for r in rows], "g int, one_ double, x double, y double")
    assert random_intercept(flat, "g", "y", ["one_", "x"])["fallback"] == 1
    few = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 5.0)], "g int, x double, y double")
    back = random_intercept(few, "g", "y", ["x"])
    assert back["fallback"] == 1 and abs(back["x"] - fixed_effects(few, "g", "y", ["x"])["x"]) < 1e-12 and back["x"] == 3
    assert math.isnan(random_intercept(few.limit(0), "g", "y", ["x"])["x"])
