import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS long, key string, hits string, w string, t string, size string"


def rows():
    """Small texts with the awkward cases: null, empty, blank, ties, repeats, long texts, odd characters, clashing columns."""
    rnd = random.Random(5)
    words = "the of and house river Stone étude naïve über año mit license apache general public lineage x1 42 a # ** |".split()
    out, texts = [], [None, "", " \t\n\r\x0b\f ", "one", "two words", "a b c", "\x1c\x85\xa0 not white", "İ K Straße ÀÉ 😀 x", "tie tie tie tie tie tie tie tie tie tie"]
    for _ in range(60):
        texts.append(" ".join(rnd.choices(words, k=rnd.randint(1, 90))))
    base = " ".join(rnd.choices([w + str(i) for i, w in enumerate(words * 20)], k=700))
    texts += [base, base, base + " end", base.replace("river", "lake", 1), base.upper(), base[40:], "lead " + base]
    texts += ["line one two three four five six\n" * 4 + "other", "\n\nx\n x\nx\n", "MIT License and the Apache-License, the General Public License. mit license mit license"]
    texts.append(" ".join(rnd.choices(words, k=9000)))
    for i, t in enumerate(texts):
        out.append((i * 3 + 1, t, None, None if i % 7 == 0 else f"src{i % 5}" if i % 2 else "hot", 0, 5, "k", "h", "w", "t", "s"))
    out.append(out[12])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
