"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed; of the k-gram hashes (k = 5) in every six
consecutive positions the least is kept, so any shared run of 10 words shares a kept
fingerprint at the same place. Kept fingerprints of the documents are joined with those of
the benchmark inside the scan; each that is found is extended to the windows of ten words
around it, whose hashes are looked up among the benchmark's distinct windows and checked
byte by byte. The windows found are the hits, overlapping ones one run. Items shorter than a
window are looked up whole, by length.

A window that many items share, or one item many times, is one entry with one set of items;
equal sets are one set. So work and memory follow the words of either side, not the pairs of
their places, and a document's items are the union of its distinct sets.

The benchmark comes in blocks of about `block_words` words (by counting words and dealing
distinct items by hash). One block is a step of the scan, and nothing is shuffled. More
blocks are taken one after the other: each is collected, broadcast, used for a scan whose
hits are written, and released, so the driver and the workers hold one block at a time.

Edge cases: null texts have no words on either side; items without words never occur;
null item_ids are counted as one item without a name in the list; repeated item_ids
count once, repeated documents are judged row by row; empty tables on either side give
no hits; extra columns of the documents are passed on by `mark` unless their names are
those of its results. Texts are judged whole; periodic and very long ones take linear time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PUNCT_RE, ascii_lower, byte_table, hashed_words, text_chunks, written

WINDOW, K = 10, 5
SPAN = WINDOW - K + 1
#: Benchmark words held by a Python worker at once: about 100 MB.
BLOCK_WORDS = 2_000_000
TABLE = byte_table(white=False)
RESULTS = ("n_words", "hits", "item_ids")
_Q = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i, 1 << 64)) for i in range(WINDOW)]
_LOW = np.uint64((1 << 20) - 1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of k consecutive word hashes."""
    n = max(len(h) - k + 1, 0)
    with np.errstate(over="ignore"):
        g = h[:n] * _Q[0]
        for i in range(1, k):
            g = g + h[i : i + n] * _Q[i]
    return g


def winnow(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the k-grams that are least in some window; ties are all kept."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), h[:0]
    g = grams(h, K)
    least = g[:n].copy()
    for i in range(1, SPAN):
        np.minimum(least, g[i : i + n], out=least)
    whole = doc[WINDOW - 1 :] == doc[:n]
    kept = np.zeros(len(g), bool)
    for i in range(SPAN):
        kept[i : i + n] |= whole & (g[i : i + n] == least)
    at = np.flatnonzero(kept)
    return at, g[at]


class Phrases:
    """The distinct runs of n words of a block that count as windows: sorted hashes, a place of each, its set of items."""

    def __init__(self, n: int, at: np.ndarray, h: np.ndarray, item: np.ndarray, sets: dict[bytes, int]):
        order = np.lexsort((item, h))
        h, item, at = h[order], item[order], at[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        self.n, self.h, self.at = n, h[new], at[new]
        bounds = np.append(np.flatnonzero(new), len(h))
        single = np.append(True, (item[1:] != item[:-1]) | new[1:])[: len(h)]
        # A window of one item, the usual case, has that item's own set.
        first, last = item[bounds[:-1]], item[bounds[1:] - 1]
        self.sets = first.copy()
        for i in np.flatnonzero(first != last).tolist():
            part = slice(bounds[i], bounds[i + 1])
            members = np.ascontiguousarray(item[part][single[part]])
            self.sets[i] = sets.setdefault(members.tobytes(), -len(sets) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the run with each hash, or -1."""
        i = np.searchsorted(self.h, h)
        i[i == len(self.h)] = 0
        return np.where(self.h[i] == h, i, -1)


class Block:
    """The items of one block: words, fingerprints, distinct windows and short items."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        joined = b"".join(raw)
        item, self.s, self.e, h = hashed_words(np.frombuffer(joined, np.uint8), off, TABLE)
        self.lower = joined.lower()
        self.g = np.unique(winnow(item, h)[1])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.g & _LOW).astype(np.int64)] = True
        sets: dict[bytes, int] = {}
        count = np.bincount(item, minlength=len(items)) if len(item) else np.zeros(len(items), np.int64)
        first = np.searchsorted(item, np.arange(len(items)))
        whole = np.flatnonzero(item[WINDOW - 1 :] == item[: max(len(item) - WINDOW + 1, 0)])
        self.windows = Phrases(WINDOW, whole, grams(h, WINDOW)[whole], item[whole], sets)
        self.short = []
        for n in range(1, WINDOW):
            own = np.flatnonzero(count == n)
            if len(own):
                self.short.append(Phrases(n, first[own], grams(h, n)[first[own]], own, sets))
        self.members = {k: np.frombuffer(b, np.int64) for b, k in sets.items()}

    def same(self, low: bytes, s: np.ndarray, e: np.ndarray, d: int, b: int, n: int) -> bool:
        return all(low[s[d + i] : e[d + i]] == self.lower[self.s[b + i] : self.e[b + i]] for i in range(n))

    def hits(self, doc: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, low: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """First words (of the chunk's words) of runs found, their sets of items, and their length."""
        for phrases in (self.windows, *self.short):
            n = phrases.n
            if not len(phrases.h) or len(h) < n:
                continue
            if n == WINDOW:
                at, g = winnow(doc, h)
                maybe = self.bits[(g & _LOW).astype(np.int64)]
                at, g = at[maybe], g[maybe]
                i = np.searchsorted(self.g, g)
                i[i == len(self.g)] = 0
                at = at[self.g[i] == g]
                # Every window that holds the fingerprint.
                near = np.zeros(len(h) - n + 1 + SPAN, bool)
                for k in range(SPAN):
                    near[np.maximum(at - k, 0)] = True
                at = np.flatnonzero(near[: len(h) - n + 1])
            else:
                at = np.arange(len(h) - n + 1)
            at = at[doc[at] == doc[at + n - 1]]
            found = phrases.find(grams(h, n)[at])
            at, found = at[found >= 0], found[found >= 0]
            ok = [self.same(low, s, e, x, y, n) for x, y in zip(at.tolist(), phrases.at[found].tolist(), strict=True)]
            at, found = at[ok], found[ok]
            if len(at):
                yield at, phrases.sets[found], n

    def items(self, sets: np.ndarray) -> set[int]:
        """The items of some sets: a set from 0 on is the item of that number."""
        one = np.unique(sets)
        return set(np.unique(np.concatenate([one[one >= 0], *[self.members[k] for k in one[one < 0].tolist()]])).tolist())


def runs_of(at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of words covered by stretches of n words from at on; at in order."""
    end = np.maximum.accumulate(at + n)
    new = np.flatnonzero(np.append(True, at[1:] > end[:-1]))
    return list(zip(at[new].tolist(), end[np.append(new[1:], len(at)) - 1].tolist(), strict=True))


def judged(known: Block, b: pa.RecordBatch, text: str) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, list[str | None]]]:
    """Words of each row of a batch; runs and item ids, sorted as strings, of the rows with hits."""
    sizes, runs, names = np.zeros(len(b), np.int64), {}, {}
    for lo, hi, raw, off in text_chunks(b, text):
        doc, s, e, h = hashed_words(raw, off, TABLE)
        sizes[lo:hi] = np.bincount(doc, minlength=hi - lo) if len(doc) else 0
        first, found = np.searchsorted(doc, np.arange(hi - lo)), list(known.hits(doc, s, e, h, raw.tobytes().lower()))
        if not found:
            continue
        at = np.concatenate([x for x, _, _ in found])
        order = np.argsort(at, kind="stable")
        at, sets, n = at[order], np.concatenate([y for _, y, _ in found])[order], np.concatenate([np.full(len(x), k) for x, _, k in found])[order]
        row = doc[at]
        cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)).tolist()
        for x, y in zip(cut, cut[1:]):
            r = int(row[x])
            runs[lo + r] = runs_of(at[x:y] - first[r], n[x:y])
            names[lo + r] = sorted({known.ids[i] for i in known.items(sets[x:y])}, key=lambda v: (v is None, (v or "").encode()))
    return sizes, runs, names


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """Number of blocks, and the distinct items of one after the other."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).distinct()
    words = items.agg(F.sum(F.size(F.split(ascii_lower(F.coalesce("t", F.lit(""))), PUNCT_RE)))).first()[0]
    many = max(1, -(-int(words or 0) // block_words))
    part = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(many)))
    return many, ([(r.i, r.t) for r in part.filter(F.col("part") == k).collect()] for k in range(many))


HITS, IDS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string())


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hits (merged runs of hit words: start, end) and item_ids (distinct, sorted as strings)."""
    many, each = blocks(benchmark, item, item_text, block_words)
    base = docs.drop(*RESULTS)
    more = T._parse_datatype_string("n_words long, hits array<struct<s:bigint,e:bigint>>, item_ids array<string>").fields
    if many > 1:
        return _by_blocks(base, each, text)
    sent = docs.sparkSession.sparkContext.broadcast(Block(next(each)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, names = judged(sent.value, b, text)
            hits = pa.array([[{"s": x, "e": y} for x, y in runs.get(r, ())] for r in range(len(b))], HITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), hits, pa.array([names.get(r, []) for r in range(len(b))], IDS)], names=[*b.schema.names, *RESULTS])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *more]))


def _by_blocks(base: DataFrame, each: Iterator[list[tuple[str | None, str | None]]], text: str) -> DataFrame:
    """A scan a block over a written table of numbered rows; only rows with hits are written, then joined and merged."""
    spark, names = base.sparkSession, base.columns
    rows = written(base.select(F.monotonically_increasing_id().alias("row__"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("base__"), F.col(text).cast("string").alias("text__")), "numbered")
    hits = None
    for items in each:
        sent = spark.sparkContext.broadcast(Block(items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, runs, ids = judged(sent.value, b, "text__")
                at = sorted(runs)
                cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array([[{"s": x, "e": y} for x, y in runs[r]] for r in at], HITS), pa.array([ids[r] for r in at], IDS)]
                yield pa.RecordBatch.from_arrays(cols, names=["r", "hits", "item_ids"])

        found = written(rows.select("row__", "text__").mapInArrow(run, "r long, hits array<struct<s:bigint,e:bigint>>, item_ids array<string>"), "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("r").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), F.flatten(F.collect_list("item_ids")).alias("i"))
    # Runs in order of start: one that begins within or at the end of what came before goes on with it.
    ends = F.transform("h", lambda x, k: F.struct(x["s"].alias("s"), F.array_max(F.transform(F.slice("h", F.lit(1), k + 1), lambda y: y["e"])).alias("e")))
    merged = written(merged.select("r", ends.alias("h"), F.array_distinct("i").alias("i")), "merged")
    heads = F.filter("h", lambda x, k: (k == 0) | (x["s"] > F.get("h", k - 1)["e"]))
    merged = merged.select("r", "h", heads.alias("heads"), "i")
    upto = lambda k: F.coalesce(F.get("heads", k + 1)["s"], F.lit(2**62))
    runs = F.transform("heads", lambda x, k: F.struct(x["s"].alias("s"), F.array_max(F.transform(F.filter("h", lambda y: (y["s"] >= x["s"]) & (y["s"] < upto(k))), lambda y: y["e"])).alias("e")))
    named = F.concat(F.array_sort(F.filter("i", lambda v: v.isNotNull())), F.filter("i", lambda v: v.isNull()))
    merged = merged.select("r", runs.alias("hits"), named.alias("item_ids"))
    n_words = F.size(F.array_remove(F.split(ascii_lower(F.coalesce("text__", F.lit(""))), PUNCT_RE), "")).cast("long")
    out = rows.join(merged, F.col("row__") == F.col("r"), "left")
    return out.select(*[F.col(f"base__.`{c}`").alias(c) for c in names], n_words.alias("n_words"), *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("hits", "array<struct<s:bigint,e:bigint>>"), ("item_ids", "array<string>"))])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


ORACLE = r"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
sizes as (select distinct least(10, len(w)) as n from items where len(w) > 0),
iwin as (select distinct item_id, least(10, len(w)) as n, w[i:i + least(10, len(w)) - 1] as k from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) as r(i) where len(w) > 0),
dwin as (select doc_id, n, i, w[i:i + n - 1] as k from docs, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) as r(i)),
hits as (select doc_id, item_id, i, d.n from dwin d join iwin using (n, k)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join words x on x.doc_id = d.doc_id left join named y on y.doc_id = d.doc_id
"""
