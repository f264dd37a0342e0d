"""Fingerprints, hard negatives and vector codes against plain Python."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest

VECTORS = "vec_id long, label int, embedding array<float>, code string, V string, rank int"


def vector_rows():
    """Clusters, ties, repeated rows, null and odd components, short vectors, null labels and ids."""
    rnd = random.Random(9)
    centres = [[rnd.gauss(0, 0.5) for _ in range(32)] for _ in range(6)]
    rows = []
    for i in range(260):
        c = centres[i % 6]
        rows.append((i, i % 4, [x + rnd.gauss(0, 0.05 if i % 3 else 0.4) for x in c]))
    rows += [(300 + i, 1, [0.25] * 32) for i in range(30)]  # equal vectors: ties everywhere
    rows += [(350, 1, [0.25] * 32), (350, 1, [0.25] * 32), (351, 2, [0.25] * 32)]
    rows += [(400, None, centres[0]), (450, 1, None), (500, 1, [None, *centres[1][1:]]), (550, 2, [math.nan] * 32), (600, 2, [math.inf, *centres[1][1:]])]
    rows += [(650, 3, centres[2][:20]), (700, 3, []), (None, 1, centres[1]), (750, 0, [-x for x in centres[1]]), (800, 7, [0.0] * 32)]
    return [(*r, "c", "v", 1) for r in rows]


def ints(rows, width):
    out = []
    for i, label, v, *_ in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = np.float32(v).astype(float).tolist()
        out.append((i, label, [math.floor(256 * x) for x in v] + [0] * (width - len(v))))
    return out


def last(i):
    return math.inf if i is None else i


def brute_negatives(rows):
    kept = [r for r in ints(rows, 32) if r[1] is not None]
    x = np.array([r[2] for r in kept])
    out = []
    for a, (ai, al, _) in enumerate(kept):
        if ai is None or ai % 50:
            continue
        s = (x @ x[a]).tolist()
        order = sorted((k for k in range(len(kept)) if k != a), key=lambda k: (-s[k], last(kept[k][0])))
        for p in [k for k in order if kept[k][1] == al][:5]:
            band = [k for k in order if kept[k][1] != al and 50 * s[p] <= 100 * s[k] <= 95 * s[p]]
            out += [(ai, kept[p][0], r + 1, kept[k][0], s[p], s[k]) for r, k in enumerate(band[:3])]
    return collections.Counter(out)


@pytest.mark.parametrize("wave", [32_768, 3])
def test_hard_negatives(spark, monkeypatch, wave):
    from plumbline.llm import negatives

    monkeypatch.setattr(negatives, "BLOCK", 64)  # many blocks, cells and, for the crowd of equal vectors, parts of one cell
    df = spark.createDataFrame(vector_rows(), VECTORS).repartition(3)
    out = negatives.hard_negatives(df, wave=wave)
    got = collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())
    want = brute_negatives(vector_rows())
    assert got == want and len(want) > 40
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_dual_tree_prunes_groups_and_bounds_hold():
    from plumbline.llm.negatives import Tree, intervals, leaf_pairs

    rnd = np.random.default_rng(1)
    centres = rnd.normal(0, 300, (16, 24))
    x = np.rint(np.repeat(centres, 100, axis=0) + rnd.normal(0, 10, (1600, 24))).astype(np.int32)
    label = np.zeros(len(x), np.int64)
    a, c = Tree(x[::20], label[::20], 8), Tree(x, label, 32)
    s = a.rows @ c.rows.T
    for d in range(a.depth + 1):
        e = min(d, c.depth)
        i, j = (v.ravel() for v in np.meshgrid(np.arange(1 << d), np.arange(1 << e), indexing="ij"))
        low, high = intervals(a, i, d, c, j, e)
        for k in range(len(i)):
            part = s[a.bounds[d][i[k]] : a.bounds[d][i[k] + 1], c.bounds[e][j[k]] : c.bounds[e][j[k] + 1]]
            assert low[k] <= part.min() and part.max() <= high[k]
    tenth = np.sort(s, axis=1)[:, -10]
    i, j, _ = leaf_pairs(a, c, a.reduce(np.minimum, tenth), None, lambda *k: np.ones(len(k[1]), bool))
    assert len(i) < 0.2 * len(a.bounds[-1]) * len(c.bounds[-1])  # most of the product is never scored
    leaf = np.searchsorted(c.bounds[-1], np.argsort(-s, axis=1)[:, :10], "right") - 1
    mine = np.searchsorted(a.bounds[-1], np.arange(len(s)), "right") - 1
    assert {(int(m), int(n)) for m, row in zip(mine, leaf, strict=True) for n in row} <= set(zip(i.tolist(), j.tolist(), strict=True))


def brute_codes(rows, parts=16, entries=64, rounds=2):
    width = max((len(r[2]) for r in ints(rows, 0)), default=0)
    kept = ints(rows, width)
    w = max(1, -(-width // parts))
    x = np.array([r[2] + [0] * (w * parts - width) for r in kept], np.int64).reshape(len(kept), parts, w)
    order = sorted(range(len(kept)), key=lambda k: (last(kept[k][0]), x[k].astype("<i4").tobytes().hex().upper()))[:entries]
    books = x[order].transpose(1, 0, 2).copy()

    def near():
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], axis=1)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        j, _ = near()
        for p, e in itertools.product(range(parts), range(len(order))):
            if (j[:, p] == e).any():
                books[p, e] = x[j[:, p] == e, p].sum(axis=0) // (j[:, p] == e).sum()
    j, d = near()
    error = d.sum(axis=1).tolist()
    sums = collections.Counter()
    for r, e in zip(kept, error, strict=True):
        sums[r[1]] += e
    h = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return collections.Counter((r[0], bytes(c.tolist()).hex(), e, sums[r[1]], h) for r, c, e in zip(kept, j.astype(np.uint8), error, strict=True))


def test_vector_codes(spark, tmp_path):
    from plumbline.llm.codes import compress, op13_vector_codes

    for name, rows in (("some", vector_rows()), ("few", vector_rows()[:5]), ("none", [])):
        df = spark.createDataFrame(rows, VECTORS).repartition(3)
        df.write.parquet(str(tmp_path / name / "embeddings.parquet"))
        out = op13_vector_codes(spark, str(tmp_path / name))
        got = collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect())
        assert got == (brute_codes(rows) if rows else collections.Counter())
    kept, _ = compress(spark.createDataFrame(vector_rows(), VECTORS))
    assert {"vec_id", "label", "V", "rank", "code", "error"} <= set(kept.columns)


def test_hamerly_bounds_save_scans_and_keep_ties():
    from plumbline.llm.codes import reassign, scan

    rnd = np.random.default_rng(3)
    x = np.rint(np.repeat(rnd.normal(0, 400, (8, 4)), 500, axis=0) + rnd.normal(0, 5, (4000, 4)))
    book = x[::500].copy()
    near, best, second = scan(x, book)
    moved_to = np.rint(np.stack([x[near == k].mean(axis=0) for k in range(8)]))
    moved = np.sqrt(((moved_to - book) ** 2).sum(axis=1)) * (1 + 1e-9)
    got, upper, lower, scans = reassign(x, moved_to, moved, near, np.sqrt(best) * (1 + 1e-9), np.sqrt(second) * (1 - 1e-9))
    want, best, second = scan(x, moved_to)
    assert (got == want).all() and scans < 400
    assert (upper >= np.sqrt(best)).all() and (lower <= np.sqrt(second)).all()
    # Two entries become equally near: the lower index is taken although the row was assigned to the higher one.
    point = np.array([[0.0, 0.0]])
    near, best, second = scan(point, np.array([[9.0, 0.0], [2.0, 0.0]]))
    assert near[0] == 1
    got, *_ = reassign(point, np.array([[-2.0, 0.0], [2.0, 0.0]]), np.array([11.0, 0.0]), near, np.sqrt(best), np.sqrt(second))
    assert got[0] == 0


def shingle_set(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in words).split("\n") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components_of(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near_rows():
    """Exact, near and chained copies, a large group of near copies, texts just below the threshold, and unlike ones."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    texts, base = [], rnd.choices(words, k=300)
    for _ in range(40):
        t = list(base)
        t[rnd.randrange(300)] = rnd.choice(words)
        texts.append(" ".join(t))
    for k in range(30):
        t = rnd.choices(words, k=rnd.randint(60, 200))
        for _ in range(4):  # a chain: each a little further from the first
            texts.append(" ".join(t))
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(rnd.choices(words, k=80)))
        texts.append(" ".join(t[: len(t) // 2] + rnd.choices(words, k=len(t) // 2)))
    return [*texts, texts[0], texts[1].upper(), None, "", "  ", "one two", "ONE\ttwo", "one two three"]


def test_minhash_classes_are_those_of_all_pairs(spark):
    from plumbline.llm.minhash import fingerprinted, with_classes

    texts = near_rows()
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(sets[i], sets[j]) >= 0.8]
    root = components_of(len(texts), edges)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), 1000 - i)
    got = {r.doc_id: r.class_id for r in with_classes(fingerprinted(df), df).collect()}
    want = {1000 - i: least[root[i]] for i in range(len(texts))}
    assert sum(got[k] != want[k] for k in want) <= 2 and len(set(want.values())) < len(texts) - 100


def test_op11(spark, docs, empty, tmp_path):
    from plumbline.llm.minhash import fingerprinted, in_chunks, jaccard, likeness, op11_minhash, shingles

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_minhash(spark, str(tmp_path)).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text or ""))
    want = []
    for r, s in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = r.text or "", s.text or ""
        h = len(t) // 2
        want.append((r.doc_id, len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    # A fingerprint is a function of the text alone, and likeness an estimate of the shingles' Jaccard similarity.
    alone = {t: in_chunks([(t or "").encode()])[0].tobytes().hex() for t in {r.text for r in rows}}
    text_of = {r.doc_id: r.text for r in rows}
    assert all(r.fingerprint == alone[text_of[r.doc_id]] for r in got)
    assert all(r.near_edited == pytest.approx(likeness(*(np.frombuffer(bytes.fromhex(x), np.uint8)[None] for x in (r.fingerprint, r.edited_fingerprint)))[0]) for r in got)
    texts = [t.encode() for t in near_rows() if t]
    prints, sets = in_chunks(texts), [np.unique(shingles([t])[0]) for t in texts]
    off = [likeness(prints[i : i + 1], prints[i + 1 : i + 2])[0] - jaccard(sets[i], sets[i + 1]) for i in range(len(texts) - 1)]
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.02
    assert [len(shingles([t.encode()])[0]) for t in ("", "a", "a b c d", "a b c d e", "a b c d e f")] == [0, 1, 1, 1, 2]
    assert fingerprinted(empty).count() == 0
    one = fingerprinted(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert bytes(one.sha).hex() == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
