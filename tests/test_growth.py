"""What operators hand from task to task, against what they are given."""

import random


def shuffled(spark, run) -> int:
    """Bytes written to shuffles while run() works."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = total()
    run()
    return total() - before


def test_nearest_leaves_words_where_they_are_read(spark):
    from plumbline.operators.matching import nearest

    rnd = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    texts = spark.createDataFrame([(i, " ".join(rnd.sample(words, 250))) for i in range(2000)], "t long, text string").repartition(4).persist()
    queries = spark.createDataFrame([(i, " ".join(rnd.sample(words, 10))) for i in range(5)], "q long, text string")
    texts.count()
    # 500,000 different words of texts, a shuffled one of which is some 20 bytes.
    assert shuffled(spark, lambda: nearest(queries, texts, "q", "t").collect()) < 3_000_000


def test_nearest_takes_the_texts_of_a_key_together(spark):
    from plumbline.operators.matching import nearest

    texts = spark.createDataFrame([(1, "red fish"), (1, "blue bird"), (2, "red bird blue"), (3, None)], "t long, text string")
    got = nearest(spark.createDataFrame([(7, "fish bird")], "q long, text string"), texts, "q", "t").collect()
    assert [(r.q, r.t) for r in got] == [(7, 1)]


def test_median_in_the_plane_is_that_of_all_pairs(spark):
    import itertools

    import numpy as np

    from plumbline.operators.kernels import median_pair_cosine_plane

    rng = np.random.default_rng(3)
    rows = [("one", 0.6, 0.8), *[("same", -1.0, 0.0)] * 7, *[("zero", 0.0, 0.0)] * 4, *[("zero", 1.0, 0.0)] * 2, ("opposite", 0.0, 1.0), ("opposite", 0.0, -1.0)]
    for g, n in (("a", 101), ("b", 40)):
        t = rng.uniform(0, 2 * np.pi, n)
        t[: n // 3] = t[0]  # copies
        rows += [(g, float(np.cos(x)), float(np.sin(x))) for x in t]
    df = spark.createDataFrame(rows, "grp string, x double, y double").selectExpr("grp", "array(x, y) as u")
    for block, bins in ((1 << 16, 64), (9, 7)):
        got = {r.grp: (r.n_pairs, r["median"]) for r in median_pair_cosine_plane(df, ["grp"], "u", block, bins).collect()}
        assert set(got) == {"a", "b", "same", "zero", "opposite"}
        for g, (n, m) in got.items():
            dots = [p[1] * q[1] + p[2] * q[2] for p, q in itertools.combinations([r for r in rows if r[0] == g], 2)]
            assert n == len(dots) and abs(m - np.median(dots)) < 1e-12


def test_median_in_the_plane_of_many_rows(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.kernels import median_pair_cosine_plane

    n = 400_000  # 8e10 pairs
    a = (F.col("id") + F.lit(0.25)) * 2 * 3.141592653589793 / n
    u = spark.range(n).select(F.lit("g").alias("grp"), F.array(F.cos(a), F.sin(a)).alias("u"))
    r = median_pair_cosine_plane(u, ["grp"], "u").first()
    assert r.n_pairs == n * (n - 1) // 2 and abs(r["median"]) < 1e-4


def test_sets_of_a_pool_are_sent_few_times(spark):
    from plumbline.operators.kernels import mean_pair_jaccard

    rnd = random.Random(2)
    sets = spark.createDataFrame([("g", [rnd.getrandbits(62) for _ in range(100)]) for i in range(1500)], "grp string, g array<long>").persist()
    sets.count()
    # 1.2 MB of hashes.
    assert shuffled(spark, lambda: mean_pair_jaccard(sets, ["grp"]).collect()) < 6_000_000


def test_tfidf_mean_sends_terms_of_blocks_and_no_terms_of_texts(spark):
    from plumbline.operators import kernels

    rnd = random.Random(3)
    words = [f"{rnd.getrandbits(40):x}" for _ in range(400)]
    rows = [(i, "g", " ".join(rnd.choices(words, k=250))) for i in range(1500)]
    rows += [(9000, "g", None), (9001, "none", ""), (9002, "none", " "), (9003, "few", "red fish"), (9004, "few", "red bird")]
    texts = spark.createDataFrame(rows, "i long, grp string, text string").repartition(4).persist()
    texts.count()
    got = []
    # Some 1,000,000 different terms of texts; frequencies of larger corpora are not broadcast.
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: got.extend(kernels.mean_pair_tfidf(texts, ["grp"], "i", "text").collect())) < 8_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    w = kernels.tfidf(texts.filter("text is not null"), ["grp"], "i", kernels.word_bound_grams(texts.text)).filter("grp = 'few'").collect()
    dot = sum(a.w * b.w for a in w for b in w if a.i < b.i and a.term == b.term)
    got = {r.grp: (r.n, r["mean"]) for r in got}
    assert set(got) == {"g", "few"} and got["g"][0] == 1501 and abs(got["few"][1] - dot) < 1e-12


def test_filters_on_tree_features_parse_no_sample_again(spark):
    from plumbline.functions import syntax

    code = "def f(o, p):\n    for k, v in p.items():\n        setattr(o, k, v)\n"
    s = spark.createDataFrame([(i, "SE-28" if i % 2 else "SE-01", c) for i, c in enumerate([code, code, "x = 1", "", "def broken(:", None])], "i long, prompt_id string, code string")
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    t = syntax.with_features(s).filter("ast.mass_assignment_line is not null")
    assert parses(t) == 1 and sorted((r.i, r.ast.mass_assignment_line) for r in t.collect()) == [(0, 2), (1, 2)]
    for prompts, lines in ((None, {0: 2, 1: 2}), (("SE-28",), {1: 2})):
        m = syntax.with_mass_assignment(s, prompts)
        # Parsed before samples are joined to it.
        assert parses(m.filter("mass_line is not null")) == 0 and {r.i: r.mass_line for r in m.collect()} == {i: lines.get(i) for i in range(6)}


def test_composite_sends_keys_of_samples_and_codes_of_drawn_ones(spark):
    from plumbline.operators import legacy

    codes = [f"def f{i}(a{i}, b):\n    return [a{i} + x * {i} for x in b if x > {i * 7}]\n" * 5 for i in range(50)]
    s = spark.createDataFrame([("g" if i % 3 else None, i, codes[i * i % 50]) for i in range(20_000)], "grp string, k long, code string").repartition(4).persist()
    s.count()
    p = legacy.places(s, ["grp"], "k").orderBy("i").collect()
    assert [r[2] for r in p if r.grp] == list(range(13_333)) and [r[2] for r in p if not r.grp] == list(range(6_667))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: legacy.composite(s, ["grp"], "k").collect()) < 2_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_trigrams_are_counted_where_texts_are_read(spark):
    from collections import Counter

    from plumbline.operators.kernels import char_trigram_counts

    texts = [("en", "aaaa\x00b"), ("en", "ab"), ("en", None), (None, "né 😀😀x"), ("de", "aaa"), ("en", ""), ("en", "aaa"), ("de", "\U0010ffff￿\n")]
    want = Counter((g, t[i : i + 3]) for g, t in texts if t for i in range(len(t) - 2))
    for most in (4_000_000, 2):
        got = Counter()
        df = char_trigram_counts(spark.createDataFrame(texts, "lang string, text string"), "lang", "text", most)
        for r in df.collect():
            got[r.lang, r.gram] += r.c
        assert got == want


def written(spark, folder, seed: int) -> int:
    """Documents of one pool, of words from one list, with copies; the bytes of their texts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(600)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(100, 300))) for _ in range(1200)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate([*texts, *texts[:50], "", "a", "é 漢 😀"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return sum(len(t) for t in texts)


def test_token_sets_are_never_sent(spark, tmp_path):
    from plumbline.functions import text as tx
    from plumbline.operators import kernels
    from plumbline.plans import queries_text

    size = written(spark, tmp_path, 8)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for query, pattern in ((queries_text.token_trigram_jaccard, tx.TOKENS), (queries_text.legacy_ngram_jaccard, tx.LEGACY_TOKENS)):
        got = []
        assert shuffled(spark, lambda q=query, g=got: g.extend(q(spark, str(tmp_path)).collect())) < size
        want = kernels.mean_pair_jaccard(kernels.gram_sets(docs, "text", pattern), ["lang"]).first()
        assert [(r.n_pairs, r.mean_j) for r in got] == [(want.n_pairs, round(want["mean"], 6))] and want.n_pairs == 1253 * 1252 // 2


def test_multisets_of_texts_are_never_sent(spark, tmp_path):
    from plumbline.operators import kernels
    from plumbline.plans.queries_more import multiset_jaccard

    size = written(spark, tmp_path, 5)
    got = []
    assert shuffled(spark, lambda: got.extend(multiset_jaccard(spark, str(tmp_path)).collect())) < size
    items = kernels.multiset_items(spark.read.parquet(f"{tmp_path}/documents.parquet").filter("length(text) >= 2"), ["lang"], "text")
    want = kernels.mean_pair_jaccard(items, ["lang"]).first()
    assert [(r.n_pairs, r["mean"]) for r in got] == [(want.n_pairs, round(want["mean"], 6))] and want.n_pairs == 1251 * 1250 // 2


def test_token_sets_of_a_slice_are_those_of_its_texts():
    import numpy as np
    import pyarrow as pa

    from plumbline.operators.kernels import token_gram_sets

    rnd = random.Random(7)
    texts = ["", *["\n".join(rnd.choices(["aé", "b", "漢", "7", "+"], k=rnd.randrange(1, 40))) for _ in range(5000)], "", "b\nb", ""]
    for lo, hi in ((0, 5004), (2048, 4096), (4096, 5004), (5001, 5004)):
        s = token_gram_sets(pa.array(texts)[lo:hi], np.ones(hi - lo))
        want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split("\n") for t in texts[lo:hi])]
        assert s.size.tolist() == [len(w) for w in want] and len(s.terms) == len(set().union(*want)) and s.n.sum() == s.size.sum()


def test_mean_of_packed_texts_is_that_of_all_pairs(spark):
    from collections import Counter

    from plumbline.operators import kernels

    rnd = random.Random(6)
    texts = ["", " ", "a", "b", "é 漢 😀 é 漢 😀", "a b c", "a  b c"] + [" ".join(rnd.choices(["ab", "abc", "b", "7", "x_1", "+"], k=rnd.randrange(1, 30))) for _ in range(150)]
    rows = [("p" if i % 4 else "q", t) for i, t in enumerate(texts + texts[:40])] + [("p", None), ("one", "a b c d"), (None, "a b c d"), (None, "a b c e"), ("none", ""), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, text string").repartition(3)

    def two(t):
        return Counter(t[i : i + 2] for i in range(len(t) - 1))

    def three(t):
        w = [x for x in t.split() if x not in ("é", "漢")]  # no tokens: these begin with an ASCII letter, or are numbers or signs
        return Counter({tuple(w[i : i + 3]): 1 for i in range(len(w) - 2)})

    for items, normal, bag in ((kernels.char_bag_sets, lambda c: c, two), (kernels.token_gram_sets, kernels.token_lines, three)):
        for sizes in ({}, {"block": 500}, {"block": 500, "block_most": 700, "held": 900}):
            got = {r.grp: (r.n_pairs, r["mean"]) for r in kernels.mean_pair_text_jaccard(df, ["grp"], "text", items, normal, **sizes).collect()}
            assert set(got) == {"p", "q", "none"}
            for g, (n, mean) in got.items():
                bags = [bag(t or "") for x, t in rows if x == g]
                j = [sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0 for i, a in enumerate(bags) for b in bags[:i]]
                assert n == len(j) and abs(mean - sum(j) / len(j)) < 1e-9
