"""The pipeline's stages against plain Python, on a whole small table."""

import collections
import random
import re

import pytest
from test_more_operators import BASE, base
from test_text_operators import WHITE, fp, leak, low, plain_targets, quality_base
from test_vectors import components_of, near, shingle_set

DATA = "/root/testdata/sf0.001"


def kept_by_rules(t):
    from plumbline.llm.quality import RULES, STOP_FROM_WORDS, STOP_WORDS

    n, chars, symbols, dup, rep, _ = quality_base(t)
    stops = {w for s in STOP_WORDS for w in (s, s.capitalize(), s.upper())}
    w = re.findall(WHITE, t or "")
    m = dict(n_words=n, word_chars=chars, n_symbols=symbols, n_dup_lines=dup, n_repeat_words=rep, n_lines=len([x for x in (t or "").split("\n") if re.search(WHITE, x)]), n_stop_words=sum(x in stops for x in w), n_shouts=(t or "").count("!!"))
    for name, top, bottom, sign, limit in RULES:
        if name == "no_stop_words" and n < STOP_FROM_WORDS:
            continue
        a, b = m[top] * 100, round(limit * 100, 6) * (m[bottom] if bottom else 1)
        if a < b if sign == "<" else a > b:
            return False
    return True


def masked(t):
    out, at = "", 0
    for s, k, e in base(t):
        if s >= at:
            out += t[at:s] + f"[{list(BASE)[k].upper()}]"
        at = max(at, e)
    return out + t[at:]


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        out[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def test_quality_stage(stages):
    assert {r.doc_id for r in stages["quality"]} == {r.doc_id for r in stages["documents"] if kept_by_rules(r.text)}


def test_near_duplicates_stage(stages):
    rows = stages["quality"]
    f = {r.doc_id: fp(r.text) for r in rows}
    comp = {d: d for d in f}
    changed = True
    while changed:
        changed = False
        for a in f:
            for b in f:
                if comp[a] != comp[b] and (f[a] ^ f[b]).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    # Of those that stay, texts linked by five-word shingles.
    left = sorted(set(comp.values()))
    sets = [shingle_set(text) for text in (next(r.text for r in rows if r.doc_id == i) for i in left)]
    root = components_of(len(left), [(i, j) for j in range(len(left)) for i in range(j) if near(sets[i], sets[j]) >= 0.8])
    least = {r: min(left[k] for k in range(len(left)) if root[k] == r) for r in set(root)}
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted(least.values())


def test_near_copies_are_found_and_unlike_texts_stay(spark):
    import corpus_pipeline

    rnd = random.Random(6)
    words, rows, linked = [f"w{i}" for i in range(5000)], [], 0
    for k in range(150):
        n, changed = ((100, 1), (100, 2), (200, 3), (400, 4), (400, 8))[k % 5]
        a = rnd.choices(words, k=n)
        b = list(a)
        for i in rnd.sample(range(n), changed):
            b[i] = rnd.choice(words)
        linked += near(shingle_set(" ".join(a)), shingle_set(" ".join(b))) >= 0.8
        rows += [(2 * k, " ".join(a), "en", "a", 1), (2 * k + 1, " ".join(b), "en", "a", 1)]
    rows += [(1000 + k, " ".join(rnd.choices(words, k=120)), "en", "b", 1) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()}
    assert {i for i, *_ in rows if i % 2 == 0 or i >= 1000} <= kept
    assert 360 - len(kept) >= 0.97 * linked and linked > 100


def test_one_row_of_copies_stays(spark):
    import corpus_pipeline

    text = "some words of a text that stands here more than once and again"
    rows = [(5, text, "en", "a", 1)] * 3 + [(4, text, "en", "b", 1), (None, text, "en", "c", 1)] + [(None, "another text without an id that has copies of its own here", "en", "d", 1)] * 2 + [(9, "alone in its words", "en", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted((r.doc_id or 0, r.source) for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()) == [(0, "d"), (4, "b"), (9, "e")]


def test_decontamination_stage(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {x[0] for x in leak(stages["near_dedup"], items) if x[2] == 0}
    assert {r.doc_id for r in stages["decontaminate"]} == clean and len(clean) < len(stages["near_dedup"])


def test_personal_data_stage(stages):
    before = {r.doc_id: r.text for r in stages["decontaminate"]}
    for r in stages["personal_data"]:
        assert r.n_chars == len(r.text)
        # Discovered spans may mask more than the base; every base span is gone and the rest of the text stays.
        assert r.text == masked(before[r.doc_id]) or not base(r.text)
    assert {r.doc_id for r in stages["personal_data"]} == set(before)


def test_mixing_stage(stages):
    rows = stages["personal_data"]
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(re.findall(WHITE, low(r.text)))
    want, taken = plain_targets(size), collections.Counter()
    for r in stages["mixing"]:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    # Blocks are of one size, so a source's words come within a few of the schedule's slots of its target.
    assert all(abs(taken[s] - want[s]) <= 6 * sum(want.values()) / 100_000 + 1 for s in size) and len(stages["mixing"]) == len(rows)


def test_run_gives_the_last_stage(stages, spark):
    import corpus_pipeline

    got = sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted((r.doc_id, r.taken) for r in stages["mixing"])


def test_odd_rows_and_an_empty_table(spark, docs, empty):
    import corpus_pipeline

    for table in (docs, empty):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, DATA)
            if name != "mixing":
                assert out.columns == corpus_pipeline.COLUMNS
        out.collect()
