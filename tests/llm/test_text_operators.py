"""The operators against plain Python versions of their contracts."""

import bisect
import collections
import math
import itertools
import hashlib
import re

import pytest

WHITE = r"[^\x20\x09-\x0D]+"
PUNCT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def same(df, want, cols):
    got = collections.Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
    assert got == collections.Counter(want)


def quality_base(t):
    t = t or ""
    w = re.findall(WHITE, t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cov = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    ls = [x for x in t.split("\n") if re.search(WHITE, x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(ls) - len(set(ls)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)


def test_quality(docs, empty):
    from plumbline.llm.quality import judge

    out = judge(docs)
    same(out, [(r.doc_id, *quality_base(r.text)) for r in docs.collect()], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert {"lang", "source", "key", "hits", "kept"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert out.filter("base_failed and kept").count() == 0
    assert judge(empty).count() == 0


def fp(t):
    import xxhash

    w = re.findall(WHITE, low(t))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty):
    from plumbline.llm.simhash import near_duplicates

    rows = docs.collect()
    f = {r.doc_id: fp(r.text) for r in rows}
    comp = {d: d for d in f}
    for _ in f:
        for a in f:
            for b in f:
                if (f[a] ^ f[b]).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = [(r.doc_id, f[r.doc_id] - (1 << 64) * (f[r.doc_id] >> 63), comp[r.doc_id]) for r in rows]
    same(near_duplicates(docs), want, ["doc_id", "fp", "component_id"])
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n", [3, 200, 3000])
def test_posting_forest(n):
    import numpy as np
    from plumbline.llm.simhash import forest

    rnd = np.random.default_rng(n)
    v = np.unique(rnd.integers(0, 65536, n).astype(np.uint64))
    m = (((v & np.uint64(255)) << np.uint64(8)) | ((v >> np.uint64(8)) << np.uint64(56)) | np.uint64(0x0012345678000077)).view(np.int64)
    a, b = forest(m, (1, 7))
    root = {int(x): int(x) for x in m}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(y)] = find(x)
    want = {int(x): int(x) for x in m}
    u = m.view(np.uint64)
    todo, label = list(range(len(m))), {}
    for i in todo:
        if i in label:
            continue
        stack = [i]
        label[i] = i
        while stack:
            k = stack.pop()
            for j in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= 2).tolist():
                if j not in label:
                    label[j] = i
                    stack.append(j)
    groups = collections.defaultdict(set)
    for i in todo:
        groups[label[i]].add(find(int(m[i])))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert len(a) == len(m) - len(groups) and want


def test_components_of_paths_and_stars(spark):
    from plumbline.llm.simhash import components

    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(401, 400), (402, 401), (400, 402)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, **{200 + i: 200 for i in range(60)}, 400: 400, 401: 400, 402: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def leak(rows, items):
    out = []
    for r in rows:
        w = re.findall(PUNCT, low(r.text))
        hit, ids = set(), set()
        for i, t in items:
            v = re.findall(PUNCT, low(t))
            n = min(10, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids.add(i)
        s = ",".join(sorted(map(str, ids)))
        out.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(s.encode()).hexdigest()))
    return out


def test_decontamination(spark, docs, empty):
    from pyspark.sql import functions as F
    from plumbline.llm.decontaminate import mark

    texts = [r.text for r in docs.collect() if r.text and len(r.text) > 200]
    w = texts[0].split()
    items = [(i, " ".join(t.split()[3 * i % 9 : 3 * i % 9 + 14 + i])) for i, t in enumerate(texts[:12])]
    items += [(50, "tie"), (51, "two, WORDS"), (52, None), (53, "--"), (54, "tie tie tie tie tie tie tie tie tie tie tie"), (55, " ".join(w[:9])), (56, " ".join(w[:10])), (56, "river"), (57, "Straße ÀÉ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (1000, 40):
        out = mark(docs, bench, block_words=words)
        assert out.filter("key = 'k'").count() == docs.count()
        n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
        out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("sha"))
        same(out, leak(docs.collect(), items), ["doc_id", "n_words", "n_hit", "n_items", "sha"])
    assert mark(empty, bench).count() == 0
    assert mark(docs, bench.limit(0)).filter("size(hits) > 0 or n_words < 0").count() == 0


def test_decontamination_of_periodic_texts_and_shared_windows(spark):
    from plumbline.llm.decontaminate import mark

    def go(docs, items, **more):
        out = mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), **more)
        return sorted((r.doc_id, sum(x.e - x.s for x in r.hits), r.item_ids) for r in out.collect())

    assert go([(1, "a " * 20000)], [("x", "b " + "a " * 20000)]) == [(1, 20000, ["x"])]
    line = "this line of ten words stands in very many items "
    many = [(f"i{k:05d}", f"w{k} {line} v{k}") for k in range(10000)] + [(f"j{k:05d}", "stands in") for k in range(5000)]
    got = go([(k, f"{line}doc {k} {line}") for k in range(50)], many)
    assert all(n == 20 and ids == [i for i, _ in many] for _, n, ids in got)
    few = many[:40] + many[-40:]
    assert go([(k, f"{line}doc {k} {line}") for k in range(5)], few, block_words=100) == [(k, 20, [i for i, _ in few]) for k in range(5)]


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer
    from plumbline.llm.tokens import default_path, token_counts

    odd = ["<|endoftext|>x<|endoftext|>", " <|endoftext|>", "don't  stop \n\n  now x", "ǅ ɐ ٣ 日本 ™ ½     \x85 \x1c \x1d", "a" * 3000, " " * 500 + "x", "zzqxj Étion ouéaux 123456789 ''''"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(extra)
    tok = Tokenizer.from_file(default_path())
    want = [(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False))) for r in every.collect()]
    same(token_counts(every), want, ["doc_id", "n_bytes", "n_tokens"])
    assert token_counts(empty).count() == 0


def test_other_tokenizers(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    from plumbline.llm.tokens import token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, count in (("piece_bpe_32k.model", lambda t: len(sp.encode(t))), ("word_bpe_49k.json", lambda t: len(tok.encode(t, add_special_tokens=False)))):
        same(token_counts(docs, path=public_tokenizers.path(name)), [(r.doc_id, count(r.text or "")) for r in docs.collect()], ["doc_id", "n_tokens"])


def test_token_split_agrees_with_the_library():
    import regex
    from tokenizers import Tokenizer
    from plumbline.llm.tokens import FOREIGN, PATTERN, default_path

    pre, foreign = Tokenizer.from_file(default_path()).pre_tokenizer, regex.compile(FOREIGN).search
    safe = [c for c in map(chr, range(0x3000)) if not foreign(c)]
    assert len(safe) > 600
    for c in safe:
        for t in (f"a{c}b", f"1 {c}{c}  {c}x", f" {c}", f"{c}1!"):
            assert [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)] == regex.findall(PATTERN, t), repr(t)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(docs, empty):
    from plumbline.llm.mixing import mix

    rows = docs.collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(re.findall(WHITE, r.text or ""))
    want, got = plain_targets(size), mix(docs, slots=2000).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"] and r.key == "k" and (r.taken > 0) == (r.first_slot is not None)
        taken[r.source] += r.taken
    # What a source takes is as many equal blocks as points fall to it, and near its target.
    slots, total, place = max(2000, 1000 * len(size)), sum(want.values()), dealt(want, 0.6180339887498949, max(2000, 1000 * len(size)))
    for s in size:
        assert taken[s] == min(2 * size[s], math.floor(place[s] * (total / slots) + 0.5))
        assert abs(taken[s] - want[s]) <= 6 * total / slots + 1, (taken, want)
    again = collections.Counter((r.doc_id, r.taken, r.first_slot) for r in mix(docs.repartition(7), slots=2000).collect())
    assert again == collections.Counter((r.doc_id, r.taken, r.first_slot) for r in got)
    assert mix(empty).count() == 0


def dealt(want, step, slots):
    """Points of the sequence that fall into each source's part of the unit interval; one for a source without any."""
    names = [s for s in sorted(want, key=lambda s: (s is None, s or "")) if want[s] > 0]
    ends = list(itertools.accumulate(want[s] for s in names))
    found = collections.Counter({s: 0 for s in want})
    for i in range(1, slots + 1):
        u = i * step - math.floor(i * step)
        found[names[min(bisect.bisect_right([e / ends[-1] for e in ends], u), len(names) - 1)]] += 1
    for s in names:
        found[s] = found[s] or 1
    return found


def test_the_sequence_decides_the_mix(spark, docs, monkeypatch):
    from plumbline.llm import mixing

    golden = {(r.doc_id, r.taken, r.first_slot) for r in mixing.mix(docs, slots=2000).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)  # all points on two values: at most two sources are dealt more than their one slot
    halves = mixing.mix(docs, slots=2000).collect()
    taken = collections.Counter()
    for r in halves:
        taken[r.source] += r.taken
    assert len(golden & {(r.doc_id, r.taken, r.first_slot) for r in halves}) < len(golden) / 2
    assert sum(v > 10 for v in taken.values()) <= 2 < len(taken)


def test_one_row_repeated_is_dealt_to_many_buckets(spark):
    from plumbline.llm.mixing import copies, mix

    same = spark.range(900).selectExpr("5L as doc_id", "'a b c' as text", "'s' as source").repartition(4)
    got = mix(same, slots=500).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 6 for r in got) and abs(sum(r.taken for r in got) - 1.5 * 2700) <= 1.5 * 2700 / 1000 * 2
    numbered = copies(same.selectExpr("monotonically_increasing_id() as uid", "doc_id", "3L as size", "0 as place"))
    assert sorted(r.copy for r in numbered.collect()) == list(range(900))
