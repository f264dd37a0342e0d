"""Properties, golden values and round trips of the library's own operators."""

import ast
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

DATA = "/root/testdata/sf0.001"


def norm(v):
    import decimal

    v = float(v) if isinstance(v, decimal.Decimal) else v
    return f"{v:.6g}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else "~" if v is None else str(v)


def catalogue():
    from plumbline.plans.registry import ORACLE  # noqa: F401
    import __spark_entry__ as e

    return [n for n in e.queries() if not n.startswith("op") and n != "pipeline"], e


NAMES = catalogue()[0]


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    e = catalogue()[1]
    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in e.oracle_sql():
        r = duck.sql(e.oracle_sql()[name])
        assert sorted(r.columns) == cols
        assert got == sorted(tuple(norm(x[r.columns.index(c)]) for c in cols) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 8), max_size=5), min_size=2, max_size=12))
def test_effective_number_properties(sets):
    from plumbline.operators.kernels import effective_number, jaccard_matrix

    k = jaccard_matrix(sets)
    v = effective_number(k)
    assert 1 - 1e-6 <= v <= len(sets) + 1e-6 and np.allclose(k, k.T)
    order = random.Random(1).sample(range(len(sets)), len(sets))
    assert abs(v - effective_number(k[np.ix_(order, order)])) < 1e-6
    distinct = sorted(set(sets), key=sorted)
    weights = np.array([sets.count(s) for s in distinct], float)
    assert abs(v - effective_number(jaccard_matrix(distinct), weights)) < 1e-5


def test_effective_number_extremes():
    from plumbline.operators.kernels import effective_number

    assert abs(effective_number(np.ones((7, 7))) - 1) < 1e-6 and abs(effective_number(np.eye(7)) - 7) < 1e-6
    assert effective_number(np.zeros((0, 0))) == 0 and effective_number(np.ones((1, 1))) == 1
    counts = np.array([5, 3, 2])
    p = counts / 10
    assert abs(effective_number(np.eye(3), counts.astype(float)) - np.exp(-(p * np.log(p)).sum())) < 1e-6


def test_tree_distance():
    from plumbline.functions.syntax import features, tree_distance, tree_similarity

    t = lambda s: features(s)["tree"]
    assert tree_distance(t("x = 1"), t("x = 1")) == 0
    assert tree_distance("a:0 b:0 c:2", "a:0 c:1") == 1 and tree_distance("a:0", "b:0") == 1
    assert tree_distance("a:0 b:0 f:2 c:0 d:0 g:2 h:2", "a:0 c:0 g:2 h:1") == 5
    assert tree_similarity(t("def f(a): return a"), t("def g(b): return b")) == 1.0 and tree_similarity(None, t("x")) == 0.0


def test_tree_distance_against_plain_recursion():
    from functools import cache

    from plumbline.functions.syntax import postorder, tree_distance

    def forest(n):
        return (type(n).__name__, tuple(forest(c) for c in ast.iter_child_nodes(n)))

    @cache
    def dist(a, b):
        if not a and not b:
            return 0
        if not a or not b:
            f = a or b
            return 1 + dist(f[:-1] + f[-1][1], ())
        (x, xs), (y, ys) = a[-1], b[-1]
        return min(dist(a[:-1] + xs, b) + 1, dist(a, b[:-1] + ys) + 1, dist(a[:-1], b[:-1]) + dist(xs, ys) + (x != y))

    codes = ["x = 1", "x = y + 1", "f(x)", "if a:\n  b", "for i in x:\n  y", "def f(a):\n  return a"]
    for a in codes:
        for b in codes:
            ta, tb = ast.parse(a), ast.parse(b)
            assert tree_distance(" ".join(postorder(ta)), " ".join(postorder(tb))) == dist((forest(ta),), (forest(tb),)), (a, b)


def test_features_of_code():
    from plumbline.functions.syntax import features

    f = features("import os.path\nfrom a.b import c\nclass K:\n    def m(self, x: int):\n        for i in x:\n            if i:\n                yield i\n")
    assert f["imports"] == ["a", "os"] and f["num_methods"] == 1 and f["max_nesting_depth"] == 4 and f["uses_generators"] and f["uses_type_hints"] and f["uses_oop"]
    assert features("def f(:\n  import x")["parse_ok"] is False and features(None)["loc"] == 0
    assert features("def add(total):\n    return total")["renamed"] == "def func_0(arg_0):\n    return arg_0"


def test_greedy_is_the_sequential_pick(spark):
    import math

    from plumbline.operators.matching import greedy

    rnd = random.Random(4)
    rows = [(i, rnd.randrange(12), f"Head {rnd.randrange(9)}", round(rnd.random(), 3), rnd.randrange(40)) for i in range(120)]
    got = [r.match_id for r in greedy(spark.createDataFrame(rows, "match_id long, problem_id long, prompt string, similarity double, n_solutions int"), 6).orderBy("place").collect()]
    ids, heads, want = set(), set(), []
    for m, p, h, s, n in sorted(rows, key=lambda r: (-r[3] * math.log1p(r[4]), r[0])):
        if len(want) < 6 and s >= 0.3 and n >= 15 and p not in ids and h.lower() not in heads:
            ids.add(p)
            heads.add(h.lower())
            want.append(m)
    assert got == want


def test_regressions(spark):
    from plumbline.operators.inference import fixed_effects, random_intercept

    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(2 + 3 * x + 1.5 * (g % 5) + rng.normal() * 0.1)) for g in range(40) for x in rng.normal(size=8)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    assert abs(fixed_effects(df, "g", "y", ["x"])["x"] - 3) < 0.02
    r = random_intercept(df, "g", "y", ["x"])
    assert abs(r["x"] - 3) < 0.02 and abs(r["residual"] - 0.01) < 0.003 and 3 < r["group_variance"] < 7


def test_whole_tables_are_covered(spark, duck, tmp_path):
    """Rows that the older queries leave out count in the whole ones: ids of 3000 and over, other sources, other lines."""
    import collections

    e = catalogue()[1]
    rnd = random.Random(8)
    rows = [(rnd.randrange(60), i * 7, rnd.choice(["error", "view"])) for i in range(1200)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    traces, pools = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for u, i, t in rows:
        traces[u].append("ERR" if t == "error" else f"OK:{i % 3}")
    for u, t in traces.items():
        if set(t) != {"ERR"}:
            pools[u % 10][";".join(t)] += 1
    got = {r.prompt: (r.n, r.clusters) for r in e.queries()["trace_effective_size"](spark, str(tmp_path)).collect()}
    assert got == {p: (sum(c.values()), len(c)) for p, c in pools.items()}
    n = duck.sql("select count(*) from lineitem").fetchall()[0][0]
    assert e.queries()["rank_correlation"](spark, DATA).first().n == n
    want = duck.sql("select sum(n * (n - 1) // 2) from (select count(*) as n from documents where length(text) >= 2 group by lang, source)").fetchall()[0][0]
    assert sum(r.n_pairs for r in e.queries()["multiset_jaccard"](spark, DATA).collect()) == want


def test_composite_takes_all_samples(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.legacy import PAIRS, composite, drawn_pairs

    got = drawn_pairs(spark.createDataFrame([("a", 1), ("b", 2), ("c", 32), ("d", 40), ("e", 5000), ("f", 10**9)], "g string, n long"), ["g"]).collect()
    for g, n in (("a", 1), ("b", 2), ("c", 32), ("d", 40), ("e", 5000), ("f", 10**9)):
        own = [(r.i, r.j) for r in got if r.g == g]
        assert len(own) == len(set(own)) == min(PAIRS, n * (n - 1) // 2) and all(0 <= i < j < n for i, j in own)
        assert n < 5000 or max(j for _, j in own) > n * 9 // 10
    df = spark.range(400).select(F.lit("p").alias("prompt_id"), "id", F.when(F.col("id") % 2 == 0, "x = 1").otherwise("def f(a):\n    return a").alias("code"))
    r = composite(df, ["prompt_id"], "id").first()
    assert r.n_samples == 400 and 0.4 < r.ngram < 0.6  # half of the pairs are of one kind


def test_tree_and_tfidf_kernels(spark):
    from plumbline.operators.kernels import KERNELS, tree_matrix

    t = ["m:0 x:1", None, None, "m:0 x:1"]
    assert tree_matrix(t).tolist() == [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 1]]
    codes, c = ["", " a", "x = call(y)", "x = call(z)", "zzz zzz"], np.array([1, 1, 1, 2, 1])
    k = KERNELS["tfidf"](codes, c)
    whole = KERNELS["tfidf"](list(np.repeat(codes, c)), np.ones(6))
    assert np.allclose(whole, np.repeat(np.repeat(k, c, 0), c, 1)) and np.allclose(np.diag(k), 1)
    assert abs(k[0, 1] - 1) < 1e-9 and 0 < k[2, 3] < 1 and k[2, 4] == 0


def test_ablation_scores_see_near_copies(spark):
    """Without family beta the pools lose its models' samples, by every kernel; the rate of exact matches cannot tell near copies."""
    e = catalogue()[1]
    got = e.queries()["family_ablation_scores"](spark, DATA).collect()
    assert {r.kernel for r in got} == {"token", "tree", "tfidf"} and {r.without_family for r in got} == {None, "alpha", "beta", "gamma"}
    n = {(r.prompt_id, r.without_family): r.n for r in got if r.kernel == "token"}
    assert all(n[p, f] < n[p, None] for p, f in n if f == "alpha") and all(1 - 1e-6 <= r.score <= r.n + 1e-6 and r.lo <= r.hi for r in got if r.n)


def test_readers_and_sinks(spark, tmp_path):
    import zipfile

    from plumbline.operators.scan import scan
    from plumbline.sources import fixtures, readers, sinks

    rows = [(p, "m", t, i, "```python\nx = eval(input())\n```") for p in ("A-1", "B-2") for t in (0.0, 0.70001) for i in range(3)]
    df = spark.createDataFrame(rows, "prompt_id string, model_display string, temperature double, sample_index int, response_text string")
    sinks.append_log(df, f"{tmp_path}/log")
    (tmp_path / "log" / "bad.json").write_text("{not json\n\n")
    assert readers.responses(spark, f"{tmp_path}/log").count() == 12
    assert readers.responses(spark, f"{tmp_path}/log", ["A-1"], 0.7, 0.01).count() == 3 and readers.responses(spark, f"{tmp_path}/log", temperature=[0.0, 0.7]).count() == 6
    sinks.merged(df, f"{tmp_path}/merged")
    assert readers.human(spark, None).count() == 0
    found = scan(fixtures.code_samples(spark, DATA)).withColumn("temperature", __import__("pyspark").sql.functions.lit(0.0))
    sinks.scan_cache(found, f"{tmp_path}/scan")
    n = found.count()
    assert readers.scan_results(spark, f"{tmp_path}/scan").filter("is_vulnerable is not null").count() == n
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for i, f in enumerate(sorted((tmp_path / "scan").glob("*.json"))):
            z.write(f, f"{i}.jsonl")
    assert readers.scan_results(spark, f"{tmp_path}/s.zip").count() == n
    sinks.csv(sinks.signature_rows(found), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == n
    (tmp_path / "cvss.json").write_text(json.dumps({"_meta": {"CWE-1": 1}, "a": {"CWE-089": 9.0, "_c": "x"}, "b": {"CWE-89": 8.5, "CWE-22_x": 8.1}}))
    assert {r.cwe: r.severity for r in readers.severity_table(spark, f"{tmp_path}/cvss.json").collect()} == {"CWE-89": 8.5, "CWE-22": 8.1}
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg" / "c.jsonl").write_text('{"name":"a","exists":false,"fetched_at_unix":1}\n{"name":"a","exists":true,"fetched_at_unix":900000}\n')
    assert [r["exists"] for r in readers.registry(spark, f"{tmp_path}/reg").collect()] == [True] and readers.registry(spark, f"{tmp_path}/reg", 9e9).count() == 0
    pool = spark.createDataFrame([("d", "s", i, "p" * (150 + 100 * i), "open", "python") for i in range(4)], "dataset string, split string, row_index int, prompt string, label string, task_language string")
    asked, missing = readers.prompts_by_key(pool, readers.parse_specs("d:s:2, d:s:0,x:s:1"))
    assert [r.row_index for r in asked.collect()] == [2, 0] and missing.count() == 1
    assert [r.id for r in readers.open_ended(pool, "open", "python", limit=2).collect()] == ["DS-01", "DS-02"]
    assert sinks.without_models(df, ["m"]).count() == 0 and "| prompt_id |" in sinks.report({"t": df.select("prompt_id")})[1]


def test_stream_equals_batch(spark, tmp_path):
    from plumbline.sources import fixtures
    from plumbline.sources.sinks import append_log
    from plumbline.streaming import incremental

    s = fixtures.code_samples(spark, DATA).drop("code", "k", "event_id")
    append_log(s, f"{tmp_path}/log")
    q = incremental.start(incremental.label_counts(incremental.source(spark, f"{tmp_path}/log", 3)), "labels_now", f"{tmp_path}/ckpt")
    q.processAllAvailable()
    q.stop()
    got = {(r.prompt_id, r.model_display, r.label): r.c for r in spark.table("labels_now").collect()}
    want = {(r.prompt_id, r.model_display, r.label): r.c for r in incremental.label_counts(s).collect()}
    assert got == want


def test_pair_means_in_blocks(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from plumbline.operators.kernels import hashed_grams, mean_pair_jaccard, multiset_items, word_bound_grams

    rnd = random.Random(4)
    rows = [("p" if i % 3 else "q", sorted(rnd.sample(range(30), rnd.randrange(0, 9)))) for i in range(120)] + [("one", [1])]
    df = spark.createDataFrame(rows, "grp string, g array<long>")
    for block in (7, 1000):
        got = {r.grp: (r.n_pairs, r["mean"]) for r in mean_pair_jaccard(df, ["grp"], block=block).collect()}
        assert set(got) == {"p", "q"}
        for k in got:
            sets = [set(g) for x, g in rows if x == k]
            j = [len(a & b) / len(a | b) if a | b else 1.0 for i, a in enumerate(sets) for b in sets[:i]]
            assert got[k][0] == len(j) and abs(got[k][1] - sum(j) / len(j)) < 1e-9
    texts = ["", None, "aa aaa", "abab", "\u00e9\u3000x y", " one\ttwo\u0085three ", "\x1c\x1d z"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, text string")
    bags = {r.i: Counter(r.g) for r in t.select("i", word_bound_grams(F.coalesce("text", F.lit(""))).alias("g")).collect()}
    for i, x in enumerate(texts):
        term, tf = hashed_grams(x or "")
        assert sorted(tf.tolist()) == sorted(bags[i].values()) and len(set(term.tolist())) == len(bags[i])
    sets = {r.i: set(r.g) for r in multiset_items(t, ["i"], "text").collect()}
    two = lambda x: Counter(x[k : k + 2] for k in range(len(x) - 1))
    for i, a in enumerate(texts):
        for k, b in enumerate(texts):
            assert len(sets[i] & sets[k]) == sum((two(a or "") & two(b or "")).values())


def test_renamed_and_payload_loops():
    import ast

    from plumbline.functions.syntax import mass_assignment, renamed

    code = "def f(a, self):\n    b = a + func_0\n    return print(b, 'a b')\nclass K: pass\n"
    assert renamed(code, ast.parse(code)) == "def func_0(arg_0, self):\n    var_0 = arg_0 + var_1\n    return print(var_0, 'arg_0 var_0')\nclass cls_0: pass\n"
    line = lambda c: mass_assignment(c, ast.parse(c))
    loop = "for k, v in d.items():\n"
    assert line(loop + "    setattr(o, k, v)") == 1
    assert line(loop + "    if k in ok:\n        setattr(o, k, v)") is None
    assert line(loop + "    if hasattr(o, k):\n        setattr(o, k, v)") == 1
    assert line(loop + "    if k == 'a':\n        setattr(o, k, v)\n    setattr(o, 'x', v)") == 1
    assert line("for k in x.__dict__:\n    if k not in bad:\n        setattr(o, k, 1)") is None
    assert line("for k in x:\n    setattr(o, k, 1)") is None
    assert line(loop + "    # allowed_fields\n    if v in w:\n        setattr(o, 'z', v)") is None
    assert line("x = 1\nif x:\n    for k, v in d.items():\n        setattr(o, k, v)\n" + loop + "    setattr(o, k, v)") == 5


def test_calibration_by_hand(spark):
    from plumbline.operators.calibrate import calibrate
    from plumbline.operators.scan import FINDING, derived

    f = lambda cwe, line=1, matched="", sink="s", detector="regex": (cwe, "r", line, matched, sink, 5.0, detector)
    sql, mass, path = "cur.execute('select ? ', (a,))", "for k, v in d.items():\n    setattr(o, k, v)", "p = os.path.join('u', n)\nopen(p)"
    rows = [
        (1, "SE-04", sql, [f("CWE-89")]), (2, "SE-05", sql, [f("CWE-89")]),  # A for its prompt only
        (3, "SE-01", "app.run(debug=True)", [f("CWE-94", sink="run(debug=True)")]),
        (4, "SE-01", 'password = "admin"', [f("CWE-798", matched='password = "admin"')]),  # the match decides, and it is long
        (5, "SE-01", 'password = "admin"', [f("CWE-798")]), (6, "SE-01", "x", [f("CWE-259", matched="'admin'")]), (7, "SE-01", "x", [f("CWE-259", matched='"s3cretword"')]),
        (8, "SE-28", mass, []), (9, "SE-27", mass, []),
        (10, "SE-06", path, [f("CWE-22")]), (11, "SE-07", path, []), (12, "SE-06", path + "\nos.path.realpath(p)", []),
    ]
    df = derived(spark.createDataFrame(rows, f"id long, prompt_id string, code string, findings {FINDING}"))
    got = {r.id: ([(x.cwe, x.detector, x.severity) for x in r.findings], [r[f"fired_{c}"] for c in "abcde"], r.is_vulnerable) for r in calibrate(df).collect()}
    keep = lambda cwe: [(cwe, "regex", 5.0)]
    none = [0, 0, 0, 0, 0]
    assert got[1] == ([], [1, 0, 0, 0, 0], False) and got[2] == (keep("CWE-89"), none, True)
    assert got[3][0][0][:2] == ("CWE-489", "regex+calib-B") and got[3][1] == [0, 1, 0, 0, 0]
    assert got[4] == (keep("CWE-798"), none, True) and got[5] == ([], [0, 0, 1, 0, 0], False) and got[6][1] == [0, 0, 1, 0, 0] and got[7] == (keep("CWE-259"), none, True)
    assert [x[0] for x in got[8][0]] == ["CWE-915"] and got[8][0][0][1] == "calibration-D" and got[8][1] == [0, 0, 0, 1, 0] and got[9] == ([], none, False)
    assert [x[0] for x in got[10][0]] == ["CWE-22", "CWE-22"] and got[10][1] == [0, 0, 0, 0, 1] and got[11] == ([], none, False) and got[12] == ([], none, False)
    every = {r.id: [r[f"fired_{c}"] for c in "ade"] for r in calibrate(df, sql_prompts=None, mass_prompts=None, path_prompts=None).collect()}
    assert every[2] == [1, 0, 0] and every[9] == [0, 1, 0] and every[11] == [0, 0, 1]


def test_sources_in_order(spark, tmp_path):
    from plumbline.sources.readers import contests, executions, exercises, first_available, sourced_exercises, traces

    spark.createDataFrame([], "question string, solutions string").write.parquet(f"{tmp_path}/a/train")
    spark.createDataFrame([("t", "q", '["x", "y"]')], "source string, question string, solutions string").write.parquet(f"{tmp_path}/b/test")
    spark.createDataFrame([("n", "d", ([1, 2, 3], ["p", "c", "r"])), ("", None, None)], "name string, description string, solutions struct<language:array<int>,solution:array<string>>").write.parquet(f"{tmp_path}/c/all")
    at = lambda x, m: (x, f"{tmp_path}/{x}", m)
    label, split, rows = first_available(spark, [at("none", exercises), at("a", exercises), at("b", sourced_exercises), at("c", contests)])
    assert (label, split) == ("b", "test") and [tuple(r) for r in rows.collect()] == [("t", "?", "q", ["x", "y"])]
    _, _, rows = first_available(spark, [at("c", contests)])
    got = {r.problem_id: (r.split, r.question, r.solutions) for r in rows.collect()}
    assert got.pop("n") == ("train", "d", ["p", "r"]) and list(got.values()) == [("train", "", [])]
    assert first_available(spark, [at("none", exercises)]) is None
    lines = [{"prompt_id": "p", "model_display": "m", "sample_index": 0, "case_index": i, "outcome": o, "passed": o == "ok"} for i, o in ((1, "err"), (0, "ok"))]
    (tmp_path / "runs.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    assert [(r.trace, r.n_passed) for r in traces(executions(spark, f"{tmp_path}/runs.jsonl")).collect()] == [("ok;err", 1)]


def test_pillars_and_signature_metrics(spark):
    import math

    from plumbline.operators import pillars
    from plumbline.operators.kernels import effective_number, jaccard_matrix
    from plumbline.operators.scan import s2_metrics

    rnd = random.Random(2)
    rows = [(p, pool, m, [rnd.randrange(6) for _ in range(3)], [float(rnd.random()), 1.0]) for p in ("a", "b") for pool, m in (("inter", ""), ("human", ""), ("intra", "x"), ("intra", "y")) for _ in range(8)]
    rows += [("c", "inter", "", [1], [1.0, 0.0])] * 3
    df = spark.createDataFrame(rows, "prompt_id string, pool string, model string, g array<long>, v array<double>")
    s = pillars.scores(df, {"sets": ("g", "jaccard"), "vectors": ("v", "cosine")})
    want = effective_number(jaccard_matrix([frozenset(r[3]) for r in rows if r[:3] == ("a", "intra", "x")]))
    assert abs([r.score for r in s.collect() if (r.kernel, r.prompt_id, r.model) == ("sets", "a", "x")][0] - want) < 1e-6
    p = pillars.by_pool(s).cache()
    by = {(r.kernel, r.prompt_id, r.pool): r for r in p.collect()}
    two = [r.score for r in s.filter("kernel = 'sets' and prompt_id = 'a' and pool = 'intra'").collect()]
    assert len(two) == 2 and abs(by["sets", "a", "intra"].score - sum(two) / 2) < 1e-9 and by["sets", "a", "intra"].n == 16
    d = {(r.kernel, r.pool, r.measure): r for r in pillars.deltas(p, 2).collect()}
    assert len(d) == 8 and all(r.n == 2 for r in d.values())  # prompt c has no human pool
    mean = sum(by["vectors", x, "inter"].score - by["vectors", x, "human"].score for x in "ab") / 2
    assert abs(d["vectors", "inter", "raw"]["mean"] - mean) < 1e-9
    sig = [[("CWE-1", "a")], [("CWE-1", "a")], [("CWE-1", "b"), ("CWE-2", "c")], []]
    scanned = spark.createDataFrame([("p", x, sorted({c for c, _ in x}), bool(x)) for x in sig], "prompt_id string, pattern_signature array<struct<cwe:string,sink:string>>, cwe_set array<string>, is_vulnerable boolean")
    m = {r.mode: r for r in s2_metrics(scanned, ["prompt_id"]).collect()}
    h = lambda c: math.exp(-sum(x / sum(c) * math.log(x / sum(c)) for x in c))
    a = m["all"]
    assert (a.n, a.n_unique, a.n_unique_cwe) == (4, 3, 3) and abs(a.match_rate - 1 / 6) < 1e-9 and abs(a.indicator - h([2, 1, 1])) < 1e-6 and [(t.label, t.c) for t in a.top][0] == ("CWE-1@a", 2)
    assert abs(a.jaccard - effective_number(jaccard_matrix([frozenset(x) for x in sig]))) < 1e-6 and (m["vulnerable"].n, m["vulnerable"].n_unique) == (3, 2) and set(m) == {"all", "vulnerable"}


def test_null_pool_and_kept_matches(spark):
    from plumbline.operators import matching, pools

    rows = [(i, "big" if i % 10 else f"p{i // 10 % 4}", f"m{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, prompt_id string, model_display string")
    sizes = spark.createDataFrame([("big", 12), ("p0", 5), ("alone", 3)], "prompt_id string, n long")
    got = pools.null_pool(df, sizes, "id", cap=8).collect()
    assert {p: sum(r.prompt_id == p for r in got) for p in ("big", "p0", "alone")} == {"big": 8, "p0": 5, "alone": 3} and all(r.prompt_id != r.from_prompt for r in got)
    m = spark.createDataFrame([(i, i, f"head {i}", 0.3 + i / 100, 20 + i % 3) for i in range(40)], "match_id long, problem_id long, prompt string, similarity double, n_solutions int")
    assert {r.match_id for r in matching.greedy(m, 100, keep=5).collect()} == {35, 36, 37, 38, 39} and matching.greedy(m, 3).count() == 3
