"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints within `max_bits`
(2) differing bits differ in at most two bytes, so they share at least six positional
bytes: the guaranteed minimum of matches. Posting lists of single bytes hold a fixed
share of all fingerprints and would pair quadratically; the index therefore posts each
distinct fingerprint under every choice of six positional bytes (28 postings of 48 bits).
Two fingerprints meet in a posting exactly if their tally reaches six. A posting varies in
two bytes only, so it holds at most 65,536 distinct fingerprints whatever the input, and
members are linked inside it without listing pairs: each is looked up at its 136
neighbours of the two open bytes, verified by Hamming distance, and only a spanning
forest of the links leaves the task.

Copies share a fingerprint and collapse before the index, so a group of copies of any
size is one entry. Components come from alternating large-star and small-star steps on
tables in the shared folder.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any
other; repeated rows of one doc_id give one row each with the same result; rows with a
null doc_id get a fingerprint, take part in links, and name no component (a component
of such rows alone has a null id); an empty table gives an empty result; extra columns
are ignored. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pairs_of, release, written

SEED = 42
#: Pairs of byte positions left open by a posting, as masks of the six that stay.
OPEN = pairs_of(8, 2)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(~((0xFF << 8 * i) | (0xFF << 8 * j)) & (2**64 - 1)) for i, j in OPEN]
#: All ways to differ in at most two of sixteen bits.
NEAR = np.array([0, *[1 << i for i in range(16)], *[(1 << i) | (1 << j) for i, j in pairs_of(16, 2)]], np.uint32)


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The majority of the bits of the XXH64 hashes of a text's word shingles, repeats included."""
    import xxhash

    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # bytes: ASCII alone is lowered and 20, 09-0D alone separate
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(line[a:b], SEED) for a, b in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64, n - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes. Counts eight bits at once in the bytes of a word, 255 hashes at a time."""
    lanes, starts = np.uint64(0x0101010101010101), np.arange(0, len(hashes), 255)
    out = 0
    for s in range(8):
        part = np.add.reduceat((hashes >> np.uint64(s)) & lanes, starts)
        counts = part.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > len(hashes)).tolist():
            out |= 1 << (8 * byte + s)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t.as_py(), shingle)) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def forest(members: np.ndarray, open_bytes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of one posting within two bits, as a chain through each component."""
    m = np.unique(members)
    u = m.view(np.uint64)
    a, b = open_bytes
    low = ((u >> np.uint64(8 * a)) & np.uint64(255)).astype(np.uint32) | (((u >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint32) << np.uint32(8))
    n = len(m)
    near = []
    if n * n <= 136 * n:
        x = low[:, None] ^ low[None, :]
        i, j = np.nonzero((np.bitwise_count(x) <= 2) & (np.arange(n)[:, None] < np.arange(n)[None, :]))
        near.append((i, j))
    else:
        at = np.full(65536, -1, np.int64)
        at[low] = np.arange(n)
        for d in NEAR[1:]:
            j = at[low ^ d]
            i = np.flatnonzero(j > np.arange(n))
            near.append((i, j[i]))
    i = np.concatenate([x for x, _ in near])
    if not len(i):
        return m[:0], m[:0]
    j = np.concatenate([y for _, y in near])
    label = np.arange(n)
    while True:  # least label over the links, then over the labels' own labels
        new = label.copy()
        low_ = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low_)
        np.minimum.at(new, j, low_)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.lexsort((np.arange(n), label))
    same = label[order][1:] == label[order][:-1]
    return m[order[:-1][same]], m[order[1:][same]]


def links(fps: DataFrame) -> DataFrame:
    """a, b: a spanning set of the links between distinct fingerprints (column fp) at most two bits apart."""
    # One row becomes 28: spread the rows first, as adaptive execution sees only how small they are.
    spread = fps.repartition(max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    posted = spread.select("fp", F.explode(F.array(*[F.struct(F.lit(c).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(MASKS)])).alias("p"))
    lists = posted.groupBy("p.c", "p.key").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1).select("c", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [forest(np.asarray(m.values, np.int64), OPEN[c.as_py()]) for c, m in zip(b.column(0), b.column(1), strict=True)]
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of the links a, b.

    Large-star then small-star, each a least neighbour by partial aggregation and one join,
    until stars alone remain; every round ends in a written table. A path of n nodes takes
    about the square of log n rounds; more than `rounds` is an error, never a partial result.
    """
    e = written(edges.filter("a <> b"), "links")
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = down.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = written(small.filter("a <> b").distinct(), "stars")
        # Stars alone remain when no node is both a leaf and a centre.
        release(e)
        e = new
        if not new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() and new.count() == new.select("a").distinct().count():
            break
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable by links), root (a component's least fingerprint), one row for each row in."""
    own = written(fingerprints(docs, key, text, shingle), "fingerprints")
    each = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    tree = written(components(links(each.select("fp"))), "components")
    of = each.join(tree, each.fp == tree.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of = written(of.filter("n > 1 or root <> fp").unionByName(of.join(tree.select(F.col("root").alias("r")).distinct(), F.col("fp") == F.col("r"), "left_semi").filter("n = 1 and root = fp")), "classes")
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("f"), "component_id", "root", F.lit(True).alias("known"))
    out = own.join(named, own.fp == named.f, "left")
    return out.select("doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))


def numbered(docs: DataFrame, name: str = "row__") -> DataFrame:
    """docs as a written table with a number for each row, the same at every reading."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def others(rows: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row__") -> DataFrame:
    """Row numbers of all but one row of every component: the one with the least key (nulls last), then row, stays."""
    ids = rows.select(F.col(row).alias("n__"), F.col(key).alias("k__"))
    found = near_duplicates(rows, row, text).select(F.col("doc_id").alias("n"), "root")
    each = written(found.join(ids, F.col("n") == F.col("n__")).select("n", "root", F.struct(F.col("k__").isNull(), "k__", "n").alias("rank")), "ranks")
    best = written(each.groupBy(F.col("root").alias("r")).agg(F.min("rank").alias("best"), F.count("*").alias("size")).filter("size > 1").select("r", "best"), "best")
    return each.join(best, F.col("root") == F.col("r")).filter(F.col("n") != F.col("best.n")).select(F.col("n").alias(row))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
