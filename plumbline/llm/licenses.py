"""License scan by a positional rare-token index.

Templates are notices and paragraphs of licences (`license_texts`). One scan counts in how many
documents each of their words stands (function words aside); the `RARE` words of highest IDF
of every template make the index: word -> postings (template, position). Each file looks up
the index words it holds, wherever they stand, so a long file or one of many licences loses
none; it intersects the postings by relative position (file position minus template
position), keeps templates that at least `ALIGNED` look-ups agree on at one offset, and
verifies there that the template's mandatory key phrases stand at their places. The score
is the share of the template's words (function words aside) that stand at theirs, or 1 where a
base phrase stands.

All steps are built-in functions; texts never move. The index is the templates', a fixed
size, and so are the counts that reach the driver, one a template word.

Edge cases: null texts are empty; blank texts have no words and score 0; repeated rows are
judged each; a file with fewer than `ALIGNED` different index words has no labels of the method;
an empty table gives an empty result; extra columns are ignored or passed on by `keep`. Texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PUNCT_RE, ascii_lower, let, packed, unpacked
from .license_texts import FUNCTION_WORDS, TEXTS

# The phrases of the base, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
RARE, ALIGNED = 12, 3


def _words(text: str) -> list[str]:
    return [w for w in re.split(PUNCT_RE, text.lower()) if w]


#: (label, words, (place, word) of the key phrases) of every template.
TEMPLATES = []
for _label, _text, _phrases in TEXTS:
    _body = _words(_text)
    _at = [next((i, _words(p)) for i in range(len(_body)) if _body[i : i + len(_words(p))] == _words(p)) for p in _phrases]
    TEMPLATES.append((_label, _body, [(i + k, w) for i, ws in _at for k, w in enumerate(ws)]))


def index(frequency: dict[str, int], templates: list = TEMPLATES, rare: int = RARE) -> dict[str, list[tuple[int, int]]]:
    """Postings of the rarest words of every template; ties by word."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, body, _) in enumerate(templates):
        own = sorted({w for w in body if w not in FUNCTION_WORDS}, key=lambda w: (frequency.get(w, 0), w))[:rare]
        for p, w in enumerate(body):
            if w in own:
                found.setdefault(w, []).append((t, p))
    return found


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PUNCT_RE), "")


def starts(w: Column, phrase: str) -> Column:
    """Positions where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def here(x: Column, i: Column) -> Column:
        ok = x == first
        for k, p in enumerate(rest, 1):
            ok &= F.get(w, i + k) == p
        return F.when(ok, i)

    return F.array_compact(F.transform(w, here))


def frequencies(docs: DataFrame, text: str, templates: list = TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word, over all documents."""
    vocabulary = F.array(*map(F.lit, sorted({w for _, body, _ in templates for w in body} - FUNCTION_WORDS)))
    held = docs.select(F.explode(F.array_intersect(vocabulary, license_words(F.col(text)))).alias("w"))
    return {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list = TEMPLATES) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score, found (template label, offset, share)."""
    names, row = packed(docs, ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"), keep)
    keep = ["row__"]
    postings = index(frequencies(docs, text, templates), templates)
    vocabulary = F.array(*map(F.lit, sorted(postings)))
    words = let(docs, row__=row, w=license_words(F.col(text)))
    places = [starts(F.col("w"), p) for p, _ in BASE]
    none = F.array().cast("array<int>")
    based = let(
        words, *keep, "w",
        rare=F.array_intersect(vocabulary, "w"),
        base=F.when(F.array_contains("w", "license"), F.array(*places)).otherwise(F.array(*[none] * len(BASE))),
    )
    posted = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in at]))])
    hits = F.flatten(
        F.transform(
            F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("rare", x), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull()),
            lambda h: F.transform(F.element_at(posted, h["w"]), lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("o"))),
        )
    )
    aligned = let(based, *keep, "w", "base", hits=F.when(F.size("rare") >= ALIGNED, F.sort_array(hits)).otherwise(F.array().cast("array<struct<t:int,o:int>>")))
    # Sorted hits: the first of a run of at least ALIGNED equal ones stands for its template and offset.
    heads = F.filter("hits", lambda x, i: F.coalesce(F.get("hits", i + ALIGNED - 1) == x, F.lit(False)) & (F.get("hits", i - 1).isNull() | (F.get("hits", i - 1) != x)))
    lined = let(aligned, *keep, "w", "base", lined=F.transform(heads, lambda x: F.struct(x["t"].alias("t"), x["o"].alias("o"))))
    keys = F.array(*[F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in phrases]) for _, _, phrases in templates])
    own = F.array(*[F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in enumerate(body) if w not in FUNCTION_WORDS]) for _, body, _ in templates])
    there = lambda x: lambda q: F.coalesce(F.get("w", x["o"] + q["p"]) == q["w"], F.lit(False))

    def has(x: Column) -> Column:
        return F.forall(F.get(keys, x["t"]), there(x))

    def share(x: Column) -> Column:
        return F.size(F.filter(F.get(own, x["t"]), there(x))) / F.size(F.get(own, x["t"]))

    labels = F.array(*[F.lit(t[0]) for t in templates])
    found = F.transform(F.filter("lined", has), lambda x: F.struct(F.get(labels, x["t"]).alias("label"), x["o"].alias("offset"), share(x).alias("share")))
    judged = let(lined, *keep, "base", n_words=F.size("w").cast("long"), found=F.when(F.size("lined") > 0, found).otherwise(F.array().cast("array<struct<label:string,offset:int,share:double>>")))
    every = F.flatten("base")
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.get("base", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    return judged.select(
        *unpacked(names), "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.transform("found", lambda f: f["label"]))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))).alias("score"),
        "found",
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
