"""Repeated byte strings against a plain count of all windows."""

import collections
import random

import numpy as np
import pytest


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(r) else 0
        out.append((len(r), int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])))
    return out


def corpus(seed, length):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choices("abcdé fgh", k=n))
    common = noise(2 * length)
    texts = [None, "", "x", noise(length - 1), noise(5 * length)]
    texts += [texts[4], texts[4][: 3 * length], "y" + texts[4] + "z", "a" * (4 * length), "ab" * (3 * length), "a" * (length + 3)]
    for _ in range(25):
        i = rnd.randrange(len(common) - length)
        texts.append(noise(rnd.randint(0, 3 * length)) + common[i : i + rnd.randint(length // 2, 2 * length)] + noise(rnd.randint(0, 2 * length)))
    for _ in range(15):
        t = list(texts[4])
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(len(t))] = "#"
        texts.append("".join(t))
    for _ in range(20):  # shared left parts with other right parts, and the other way round
        i, j = sorted(rnd.sample(range(len(common)), 2))
        texts.append(common[:j] + noise(30) + common[i:])
    return texts


@pytest.mark.parametrize("seed,length,gram,group", [(1, 40, 8, 1), (2, 150, 16, 128), (3, 97, 13, 5), (4, 60, 16, 1000)])
def test_removed_bytes(spark, seed, length, gram, group):
    from plumbline.llm.substrings import kept_texts

    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, r1 int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in kept_texts(df, length=length, gram=gram, group=group).collect()}
    want = dict(enumerate(plain(texts, length)))
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, [(i, got[i][:3], want[i][:3]) for i in wrong[:5]]


def test_repeated_rows_and_empty_table(spark):
    from plumbline.llm.substrings import kept_texts

    rows = [(1, "q" * 30 + "w" * 50), (1, "q" * 30 + "w" * 50), (2, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.removed), bytes(r.kept)) for r in kept_texts(df, length=60, gram=8).collect())
    assert got == [(0, 0, 0, b""), (1, 80, 1, b""), (1, 80, 1, b""), (2, 5, 0, b"short")]
    assert kept_texts(df.limit(0)).count() == 0


def test_many_repeated_rows_and_near_copies(spark):
    from plumbline.llm.substrings import kept_texts

    rnd = random.Random(7)
    body = "".join(rnd.choices("abcdefgh ", k=4500))
    near = body[:2000] + "#" + body[2001:]
    rows = [(1, body)] * 2000 + [(2, near), (3, near + "tail"), (None, body[:700])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed)) for r in kept_texts(df).collect())
    assert got == {(1, 4500, 4500, 1): 2000, (2, 4500, 4500, 1): 1, (3, 4504, 4500, 1): 1, (None, 700, 700, 1): 1}


def plain_passages(rows, words):
    """The (id, text) that hold a run of `words` words which another holds."""
    w = {k: (k[1] or "").lower().split() for k in set(rows)}
    holders = collections.defaultdict(set)
    for k, v in w.items():
        for i in range(len(v) - words + 1):
            holders[tuple(v[i : i + words])].add(k)
    return {k for k, v in w.items() if any(len(holders[tuple(v[i : i + words])]) > 1 for i in range(len(v) - words + 1))}


def test_shared_passages(spark):
    from plumbline.llm.passages import shared_passages
    from plumbline.llm.substrings import _keyed

    rnd = random.Random(11)
    line = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    common = [line(n) for n in (10, 19, 30, 50, 51, 52, 80, 120, 300)]
    rows = [(i, f"{line(rnd.randrange(90))} {rnd.choice(common)} {line(rnd.randrange(90))}") for i in range(120)]
    rows += [(200 + i, "a " * n) for i, n in enumerate((19, 50, 51, 52, 400, 3000))] + [(300, "b " * 500), (301, None), (302, ""), (None, line(300)), (303, line(300))]
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [rows[5], rows[-2], (500, rows[5][1].upper())]
    for i in range(40):  # near copies
        t = rows[8][1].split()
        t[rnd.randrange(len(t))] = "changed"
        rows.append((600 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = _keyed(df, "doc_id", "text")
    ids = {r.r1: (r.doc_id, r.text) for r in keyed.collect()}
    got = {ids[r.rid] for r in shared_passages(keyed.selectExpr("r1 as rid", "text")).collect()}
    rows = [(i, t or "") for i, t in rows]
    sure, possible = plain_passages(rows, 51), plain_passages(rows, 20)
    assert sure <= got <= possible and len(sure) > 80 and len(possible) < len(set(rows)) - 20
    assert shared_passages(keyed.selectExpr("r1 as rid", "text").limit(0)).count() == 0
