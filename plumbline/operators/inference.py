"""Bootstrap intervals and paired tests with keyed draws, leave-one-out rates, regressions with grouped intercepts."""

from __future__ import annotations

import contextlib
import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _poisson() -> tuple[int, ...]:
    """Of 65,536 equally likely draws, from which on a Poisson(1) variable is at least 1, 2, ...."""
    upto, p, out = 0.0, math.exp(-1), []
    for k in itertools.count(1):
        upto += p
        p /= k
        if round(65536 * upto) >= 65536:
            return tuple(out)
        out.append(round(65536 * upto))


POISSON = _poisson()


def replicate_means(values: DataFrame, group: list[str], key: str, value: str, b: int, seed: str) -> DataFrame:
    """group, rep, m: the mean of a resample, b times, in one pass.

    In a replicate each row counts a Poisson(1) number of times: its own draw, four hex digits of MD5 of (seed, group,
    key, rep / 8). So no table of draws is made, no row is ranked and nothing is joined: rows become b weighted sums, added
    map-side, whatever a group's size. Against draws of exactly n rows the replicates' spread is the same to within
    a factor 1 + O(1/n); a replicate without any row (probability e^-n) is left out.
    """
    parts = [F.lit(seed), *[F.col(g).cast("string") for g in group], F.col(key).cast("string")]
    hashes = values.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"), F.posexplode(F.array(*[F.md5(F.concat_ws("|", *parts, F.lit(str(i)))) for i in range(-(-b // 8))])).alias("part", "h"))
    each = hashes.select(*group, "v", "part", "h", F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("k"))
    u = F.conv(F.substr("h", 4 * F.col("k") + 1, F.lit(4)), 16, 10).cast("int")
    drawn_ = each.select(*group, "v", (8 * F.col("part") + F.col("k")).alias("rep"), u.alias("u")).filter(F.col("rep") < b)
    weight = functools.reduce(lambda a, c: a + c, [(F.col("u") >= c).cast("int") for c in POISSON])
    w = drawn_.select(*group, "rep", "v", weight.alias("w")).filter("w > 0")
    return w.groupBy(*group, "rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))


def bootstrap_mean(values: DataFrame, group: list[str], key: str, value: str, b: int = 200, seed: str = "boot") -> DataFrame:
    """group, n, mean, lo, hi (order statistics), p: share of replicate means at or above zero where the mean is below, else one."""
    m = F.sort_array(F.collect_list("m"))  # b numbers a group
    reps = replicate_means(values, group, key, value, b, seed).groupBy(*group).agg(m.alias("s"))
    point = values.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    size = F.size("s")
    p = F.when(F.col("mean") < 0, F.size(F.filter("s", lambda x: x >= 0)) / size).otherwise(1.0)
    hi = F.greatest(F.floor(0.975 * size), F.lit(1)).cast("int") - 1
    return point.join(reps, group).select(*group, "n", "mean", F.get("s", F.floor(0.025 * size).cast("int")).alias("lo"), F.get("s", hi).alias("hi"), p.alias("p"))


def leave_one_out_match(counted: DataFrame, group: list[str], part: str) -> DataFrame:
    """Match rate of labels in each group without each part, and with all (null): from counts (group, part, label, c), subtracted."""
    c = counted.withColumn("t", F.sum("c").over(Window.partitionBy(*group, "label")))
    totals = counted.groupBy(*group, "label").agg(F.sum("c").alias("t")).groupBy(*group).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1)).alias("same"))
    less = c.groupBy(*group, part).agg(F.sum("c").alias("gone"), F.sum((F.col("t") - F.col("c")) * (F.col("t") - F.col("c") - 1) - F.col("t") * (F.col("t") - 1)).alias("change"))
    rate = lambda s, n: F.when(n > 1, s / (n * (n - 1)))
    out = less.join(totals, group).select(*group, part, (F.col("n") - F.col("gone")).alias("n"), rate(F.col("same") + F.col("change"), F.col("n") - F.col("gone")).alias("match_rate"))
    return out.unionByName(totals.select(*group, F.lit(None).cast("string").alias(part), "n", rate(F.col("same"), F.col("n")).alias("match_rate")))


def without_each(df: DataFrame, part: str, name: str = "without_family") -> DataFrame:
    """The rows once with all parts (name null), and once for each part of the table without that part's rows."""
    parts = df.select(F.col(part).alias(name)).filter(F.col(name).isNotNull()).distinct()
    less = df.join(F.broadcast(parts), ~F.col(part).eqNullSafe(F.col(name)))
    return less.unionByName(df.withColumn(name, F.lit(None).cast(dict(df.dtypes)[part])))


def fixed_effects(df: DataFrame, group: str, y: str, xs: list[str]) -> dict[str, float]:
    """Slopes of y on xs with an intercept for each group: within-group products summed in one pass, a p x p solve here."""
    names = [y, *xs]
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    # A group's products about its means are its covariances times its size: sums that combine before a shuffle.
    each = df.groupBy(group).agg(*[(F.covar_pop(names[i], names[j]) * F.count("*")).alias(f"s{i}_{j}") for i, j in at])
    sums = each.agg(*[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in at]).first()
    s = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    return dict(zip(xs, np.linalg.solve(s[1:, 1:], s[1:, 0]).tolist(), strict=True))


def random_intercept(df: DataFrame, group: str, y: str, xs: list[str], steps: int = 200) -> dict[str, float]:
    """REML of y ~ xs with a random intercept by group.

    Each group is reduced to its products (p x p), where it lies. A grid of variance ratios is judged in one pass: a
    task adds, for every ratio at once, the weighted products of its groups, Spark adds the tasks' sums, and one small matrix
    a ratio comes here, whatever the number of groups. Three finer grids about the best ratio follow. Rows
    with a null are left out. Where the sums are singular (a constant slope variable, or too few rows) the slopes are those of
    `fixed_effects`, "fallback" is 1.0 and what cannot be estimated is NaN.
    """
    names = ["one", *xs, y]
    q, p = len(names), len(xs) + 1
    d = df.dropna(subset=[group, y, *xs]).withColumn("one", F.lit(1.0))
    cells = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    groups = d.groupBy(group).agg(F.array(*cells).alias("s")).select("s").persist()
    n = groups.agg(F.sum(F.col("s")[0])).first()[0] or 0.0
    nan = float("nan")

    def judged(ratios: np.ndarray) -> list[tuple]:
        def part(batches):
            total = np.zeros((len(ratios), q * q + 1))
            for pdf in batches:
                if len(pdf):
                    g = np.stack(pdf["s"].to_numpy()).astype(float)
                    first = g[:, :q]  # sums of every column: the row of the ones
                    outer = (first[:, :, None] * first[:, None, :]).reshape(len(g), q * q)
                    k = ratios[:, None] / (1 + ratios[:, None] * g[None, :, 0])
                    total[:, :-1] += g.sum(0)[None, :] - k @ outer
                    total[:, -1] += np.log1p(ratios[:, None] * g[None, :, 0]).sum(1)
            yield pd.DataFrame({"i": np.arange(len(ratios)), "m": list(total)})

        sums = groups.mapInPandas(part, "i int, m array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("m")[j]) for j in range(q * q + 1)]).alias("m")).collect()
        out = []
        for r in sums:
            m, logdet = np.array(r.m[:-1]).reshape(q, q), r.m[-1]
            sign, size = np.linalg.slogdet(m[:p, :p])
            if sign <= 0 or np.linalg.cond(m[:p, :p]) > 1e12:
                raise np.linalg.LinAlgError("singular")
            beta = np.linalg.solve(m[:p, :p], m[:p, p])
            s2 = max((m[p, p] - beta @ m[:p, p]) / (n - p), 1e-300)
            out.append((-0.5 * (logdet + size + (n - p) * np.log(s2)), float(ratios[r.i]), beta, s2))
        return out

    try:
        if n <= p:
            raise np.linalg.LinAlgError("too few rows")
        best = max(judged(np.concatenate([[0.0], np.logspace(-6, 4, steps)])), key=lambda f: (f[0], -f[1]))
        for width in (1.2, 1.01, 1.0005):
            best = max(judged(np.linspace(best[1] / width, best[1] * width, 41)), key=lambda f: (f[0], -f[1]))
    except np.linalg.LinAlgError:
        slopes = dict.fromkeys(xs, nan)
        with contextlib.suppress(np.linalg.LinAlgError, TypeError):  # without any row, or singular within groups too
            slopes |= fixed_effects(d, group, y, xs)
        return {"intercept": nan} | slopes | {"residual": nan, "group_variance": nan, "fallback": 1.0}
    finally:
        groups.unpersist()
    _, ratio, beta, s2 = best
    return dict(zip(["intercept", *xs], beta.tolist(), strict=True)) | {"residual": float(s2), "group_variance": float(ratio * s2), "fallback": 0.0}
