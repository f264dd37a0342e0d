"""Document fingerprints by MinHash, and near-duplicates from their bands.

A text's words are its runs without white space, A-Z lowered; its shingles are five words (the
whole sequence of fewer). PERMS (128) universal permutations x -> a*x + b modulo 2**64, a odd,
are applied to the 64-bit hashes of all shingles at once in numpy; the least value under each
gives one byte of the fingerprint. The likeness of two fingerprints is the share of equal bytes,
freed of chance (1/256): an estimate of the shingle sets' Jaccard similarity, 1 for equal texts.

Near-duplicates are documents linked by a Jaccard similarity of 0.8 or more. Fingerprints are
cut into BANDS (16) of BAND (5) bytes; texts meet in a bucket if a band agrees, which pairs at
0.8 do with probability 0.998. Copies are one text, by a 64-bit hash. A bucket's texts are
dealt into groups of about GROUP; in each, the pairs of a spanning forest of greatest likeness are
verified, twice with another deal, which connects most of what belongs together by one comparison
a text. Then each text outside a bucket's greatest component is set against all the bucket's
texts of other components, in blocks, and every pair with a likeness of CUT (0.7) or more is verified.
So no pair that shares a bucket is lost but those (0.3 % at a similarity of 0.8) below CUT, and a
crowd of near copies is not compared pair by pair. Verification is exact: the texts of a pair are
brought together, hashed and intersected. Components come from alternating star steps.

The edited form of a document takes its last floor(n/2) code points from the start of the next
document by id, of the last one from the first. Texts are range-partitioned and sorted by
id, so each meets the next in its task; a partition's last text meets the next partition's
first in a second step over one row a partition. Texts travel compressed.

Edge cases: null texts are empty; texts without words have a fingerprint of zeros and are
alike (1) to each other and near duplicates of each other; documents are in the order of id
(nulls last), then of a hash of the text, then of the row's number, so repeated rows follow each
other; a table of one document takes that as its next; a class's id is its least doc_id (null
if it has none); an empty table gives an empty result; extra columns are ignored. Texts are
hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, hashed_words, mix, release, written
from .simhash import components
from .vectors import binaries, matrix

PERMS, BANDS, BAND, SHINGLE, JACCARD = 128, 16, 5, 5, 0.8
GROUP, BROADCAST_ROWS = 256, 1_000_000
#: Likeness below which a pair is not verified: at a similarity of 0.8, 99.7 % of pairs are above it.
CUT = 0.7
#: Bytes of text hashed at a time, and shingles permuted at a time.
CHUNK, SLICE = 2 << 20, 1 << 16
TABLE = byte_table(white=True)
with np.errstate(over="ignore"):
    FACTORS = mix(np.arange(1, PERMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    OFFSETS = mix(np.arange(PERMS + 1, 2 * PERMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    PLACES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' shingles in order, and where each text's begin (one more at the end)."""
    off = np.cumsum([0, *map(len, texts)])
    row, _, _, h = hashed_words(np.frombuffer(b"".join(texts), np.uint8), off, TABLE)
    words = np.bincount(row, minlength=len(texts))
    first, out = np.cumsum(words) - words, np.where(words > 0, np.maximum(1, words - SHINGLE + 1), 0)
    at = np.append(0, np.cumsum(out))
    made = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            full = np.flatnonzero(row[SHINGLE - 1 :] == row[: len(row) - SHINGLE + 1]) if len(row) >= SHINGLE else np.zeros(0, np.int64)
            made[at[row[full]] + full - first[row[full]]] += h[full + j] * PLACES[j]
            short = np.flatnonzero((words > j) & (words < SHINGLE))
            made[at[short]] += h[first[short] + j] * PLACES[j]
    return mix(made), at


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of PERMS bytes for each text."""
    out = np.zeros((len(texts), PERMS), np.uint8)
    if not texts:
        return out
    h, at = shingles(texts)
    some = np.flatnonzero(np.diff(at))
    start = at[some]
    least = np.full((PERMS, len(some)), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), SLICE):
            x = h[a : a + SLICE]
            lo, hi = np.searchsorted(start, a, "right") - 1, np.searchsorted(start, a + len(x), "left")
            begin = np.maximum(start[lo:hi], a) - a
            for p in range(PERMS):
                np.minimum(least[p, lo:hi], np.minimum.reduceat(x * FACTORS[p] + OFFSETS[p], begin), out=least[p, lo:hi])
    out[some] = (mix(least) & np.uint64(255)).astype(np.uint8).T
    return out


def in_chunks(texts: list[bytes]) -> np.ndarray:
    """fingerprints, of about CHUNK bytes of text at a time."""
    parts, a, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            parts.append(fingerprints(texts[a : i + 1]))
            a, size = i + 1, 0
    return np.concatenate([*parts, fingerprints(texts[a:])])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row."""
    return np.maximum(0.0, (256 * (a == b).mean(axis=1) - 1) / 255)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes in order; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def edited(own: bytes, following: bytes) -> tuple[int, bytes]:
    """Number of code points of a text, and the text with its second half replaced from the start of the following one."""
    t = own.decode(errors="surrogateescape")
    half = len(t) // 2
    return len(t), (t[: len(t) - half] + following.decode(errors="surrogateescape")[:half]).encode(errors="surrogateescape")


def smaller(table: DataFrame, column: str = "text") -> DataFrame:
    """table with its text column compressed, as `z`, and its bytes counted, as `n_bytes`: for texts that are to be shuffled."""
    names = [c for c in table.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            raw = [t.as_buffer() for t in b.column(len(names)).cast(pa.large_binary())]
            z = pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], z, pa.array([t.size for t in raw], pa.int64())], names=[*names, "z", "n_bytes"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in table.select(*names).schema)
    return table.select(*names, F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)).mapInArrow(run, f"{schema}z binary, n_bytes long")


def larger(z: pa.Array, n_bytes: pa.Array) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(t.as_buffer(), n, asbytes=True) if n else b"" for t, n in zip(z, n_bytes.to_pylist(), strict=True)]


PIECE = "doc_id long, rid long, n_chars long, sha binary, fp binary, edited_fp binary, near_edited double, near_next double"
EDGE = "part int, head struct<text:binary,fp:binary>, tail struct<doc_id:long,rid:long,text:binary,fp:binary>"


def _piece(ids: list, rids: list, texts: list[bytes], prints: np.ndarray, following: list[bytes], next_prints: np.ndarray) -> list[pa.Array]:
    """The columns of PIECE for texts and those that follow each."""
    made = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    other = in_chunks([e for _, e in made])
    sha = np.frombuffer(b"".join(hashlib.sha256(e).digest() for _, e in made), np.uint8).reshape(-1, 32)
    return [
        pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array([n for n, _ in made], pa.int64()), binaries(sha), binaries(prints), binaries(other),
        pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints)),
    ]


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """PIECE of every document: doc_id, rid (hash of the text), n_chars, sha and edited_fp of its edited form, fp, likenesses; a written table."""
    spark = docs.sparkSession
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("rid"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("rid").asc(), F.col("uid").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = smaller(picked).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = [f.strip().split()[0] for f in PIECE.split(",")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.float64()] * 2
    head_type = pa.struct([("text", pa.binary()), ("fp", pa.binary())])
    tail_type = pa.struct([("doc_id", pa.int64()), ("rid", pa.int64()), ("text", pa.binary()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = None
        for b in batches:
            size, a = b.column(4).to_numpy(), 0
            upto = np.cumsum(size)
            while a < len(b):  # a few megabytes of text at a time
                end = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK)))
                c = b.slice(a, end - a)
                a = end
                texts = larger(c.column(3), c.column(4))
                prints, ids, rids = in_chunks(texts), c.column(0).to_pylist(), c.column(1).to_pylist()
                if tail is None:
                    head = {"text": texts[0], "fp": prints[0].tobytes()}
                else:
                    ids, rids, texts, prints = [tail["doc_id"], *ids], [tail["rid"], *rids], [tail["text"], *texts], np.concatenate([np.frombuffer(tail["fp"], np.uint8)[None], prints])
                tail = {"doc_id": ids[-1], "rid": rids[-1], "text": texts[-1], "fp": prints[-1].tobytes()}
                if len(texts) > 1:
                    cols = _piece(ids[:-1], rids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                    n = len(texts) - 1
                    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, head_type), pa.nulls(n, tail_type)], names=[*names, "part", "head", "tail"])
        if tail is not None:
            edge = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([head], head_type), pa.array([tail], tail_type)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], *edge], names=[*names, "part", "head", "tail"])

    told = written(ordered.mapInArrow(run, f"{PIECE}, {EDGE}"), "fingerprints")
    edges = told.filter("part is not null").select("part", "head", "tail")
    places = sorted(r.part for r in edges.select("part").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "part int, next int")
    met = edges.select("part", "tail").join(after, "part").join(edges.select(F.col("part").alias("next"), "head"), "next").select("tail", "head")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails, heads = b.column(0).to_pylist(), b.column(1).to_pylist()
            prints, following = (np.frombuffer(b"".join(x["fp"] for x in t), np.uint8).reshape(-1, PERMS) for t in (tails, heads))
            yield pa.RecordBatch.from_arrays(_piece([t["doc_id"] for t in tails], [t["rid"] for t in tails], [t["text"] for t in tails], prints, [h["text"] for h in heads], following), names=names)

    return told.filter("part is null").select(*names).unionByName(met.mapInArrow(last, PIECE))


def grouped(table: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(rows of one group) -> columns, for every group of keys; groups are small, so many are met in one stream of sorted rows."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _and_end(batches):
            if b is not None:
                held.append(b)
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            if t is None or not len(t):
                continue
            change = np.zeros(len(t) - 1, bool)
            for k in keys:
                c = t.column(k).combine_chunks()
                change |= np.asarray(pa.compute.not_equal(c.slice(1), c.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False), bool)
            edge = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
            done = edge if b is None else edge[:-1]
            out = [run(t.slice(x, y - x)) for x, y in zip(done[:-1], done[1:], strict=True)]
            if out:
                cols = [np.concatenate([o[i] for o in out]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
            held = [] if b is None else t.slice(edge[-2]).to_batches()

    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def verified(pairs: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    """a, b of the pairs (a, b: hashes of texts, distinct pairs) whose shingle sets have that Jaccard similarity at least.

    The texts named are found in docs by their hashes: broadcast up to BROADCAST_ROWS, joined by a
    shuffle beyond. A group is a text and about GROUP of those it is compared with.
    """
    sizes = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "sizes")
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("rid"))
    leads = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("rid"))
    wanted = written(dealt.unionByName(leads), "wanted")
    ids = wanted.select("rid").distinct()
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("rid"), F.col(text).alias("text"))
    one = smaller(texts.join(side, "rid", "left_semi")).groupBy("rid").agg(F.first("z").alias("z"), F.first("n_bytes").alias("n_bytes"))
    met = one.join(wanted, "rid").select("a", "part", "rid", "z", "n_bytes")

    def run(t: pa.Table) -> list[np.ndarray]:
        rids, sets = t.column("rid").to_numpy(), []
        for raw in larger(t.column("z"), t.column("n_bytes")):
            sets.append(np.unique(shingles([raw])[0]))
        a = t.column("a")[0].as_py()
        lead = sets[int(np.flatnonzero(rids == a)[0])]
        good = np.array([r for r, x in zip(rids.tolist(), sets, strict=True) if r != a and jaccard(lead, x) >= least], np.int64)
        return [np.full(len(good), a, np.int64), good]

    return grouped(met, ["a", "part"], run, "a long, b long")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of every fingerprint of a to every one of b."""
    same = np.stack([(x == b).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
    return (256 * same / PERMS - 1) / 255


def promising(t: pa.Table) -> list[np.ndarray]:
    """Pairs of one group to verify: the edges between components (`own`) of a spanning forest of greatest likeness, CUT at least."""
    rid, own, prints = t.column("rid").to_numpy(), t.column("own").to_numpy(), matrix(t.column("fp"), np.uint8, PERMS)
    none = np.zeros(0, np.int64)
    if (own == own[0]).all():
        return [none, none]
    near = alike(prints, prints)
    near[own[:, None] == own[None, :]] = 2  # already one component
    n, best, via, a, b = len(rid), near[0].copy(), np.zeros(len(rid), np.int64), [], []
    todo = np.ones(n, bool)
    todo[0] = False
    for _ in range(n - 1):
        k = int(np.where(todo, best, -9).argmax())
        todo[k] = False
        if CUT <= best[k] < 2:
            a.append(rid[via[k]])
            b.append(rid[k])
        closer = near[k] > best
        best[closer], via[closer] = near[k][closer], k
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return [np.minimum(a, b), np.maximum(a, b)]


def remaining(t: pa.Table) -> list[np.ndarray]:
    """All pairs of one group, between its rows that are apart and the others, of different components, CUT at least, whose first common band is this one."""
    rid, own, prints, apart = t.column("rid").to_numpy(), t.column("own").to_numpy(), matrix(t.column("fp"), np.uint8, PERMS), np.asarray(t.column("apart").to_numpy(), bool)
    x, y = np.flatnonzero(apart), np.flatnonzero(~apart)
    i, j = np.nonzero((alike(prints[x], prints[y]) >= CUT) & (own[x][:, None] != own[y][None, :]))
    i, j = x[i], y[j]
    agree = (prints[i, : BANDS * BAND] == prints[j, : BANDS * BAND]).reshape(-1, BANDS, BAND).all(axis=2)
    first = agree.argmax(axis=1) == t.column("band")[0].as_py()[0]
    i, j = i[first], j[first]
    return [np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])]


def near_classes(prints: DataFrame, docs: DataFrame, text: str = "text", least: float = JACCARD) -> DataFrame:
    """rid, root of every text with near duplicates: root is one text of its component; prints has rid and fp of every document."""
    texts = written(prints.select("rid", "fp").dropDuplicates(["rid"]), "texts")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.concat(F.unhex(F.lpad(F.hex(i), 2, "0")), F.substring("fp", i * BAND + 1, F.lit(BAND)))))
    buckets = written(texts.select(band.alias("band")).groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    side = F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets
    members = written(texts.select("rid", "fp", band.alias("band")).join(side, "band"), "members")
    links = tree = None
    for turn in range(2):  # in groups of a bucket's texts, another deal each time: most of what belongs together is connected by few comparisons
        placed = members.withColumn("own", F.col("rid")) if tree is None else _rooted(members, tree)
        dealt = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "rid"), F.ceil(F.col("n") / GROUP)))
        pairs = written(grouped(dealt.select("band", "part", "rid", "own", "fp"), ["band", "part"], promising, "a long, b long").distinct(), "pairs")
        found = verified(pairs, docs, text, least)
        links = written(found if links is None else links.unionByName(found), "links")
        tree = written(components(links), "tree")
    # Then all pairs of a bucket that are not connected yet: the texts outside its greatest component with all others.
    placed = written(_rooted(members, tree), "placed")
    main = placed.groupBy("band", "own").agg(F.count("*").alias("m")).groupBy("band").agg(F.max(F.struct("m", "own")).alias("top"), F.sum("m").alias("n"))
    main = written(main.filter("top.m < n").select("band", F.col("top.own").alias("main"), F.ceil(F.col("n") / GROUP).alias("ys"), F.ceil((F.col("n") - F.col("top.m")) / GROUP).alias("xs")), "main")
    open_ = written(placed.drop("n").join(F.broadcast(main) if main.count() <= BROADCAST_ROWS else main, "band"), "open")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    mine = lambda n: F.pmod(F.xxhash64(F.lit(9), "rid"), n).cast("int")
    keep = ["band", "rid", "own", "fp"]
    xs = open_.filter("own <> main").select(*keep, F.lit(True).alias("apart"), mine(F.col("xs")).alias("x"), every(F.col("ys")).alias("y"))
    ys = open_.select(*keep, F.lit(False).alias("apart"), mine(F.col("ys")).alias("y"), every(F.col("xs")).alias("x"))
    more = written(grouped(xs.unionByName(ys), ["band", "x", "y"], remaining, "a long, b long").distinct(), "more")
    if more.limit(1).count():
        links = written(links.unionByName(verified(more, docs, text, least)), "links")
        tree = written(components(links), "tree")
    release(buckets, members, placed, main, open_)
    return tree.select(F.col("node").alias("rid"), "root")


def _rooted(members: DataFrame, tree: DataFrame) -> DataFrame:
    """members with own, the component of each text (itself where it has no link)."""
    side = F.broadcast(tree) if tree.count() <= BROADCAST_ROWS else tree
    return members.join(side, F.col("rid") == F.col("node"), "left").withColumn("own", F.coalesce("root", "rid")).drop("node", "root")


def with_classes(prints: DataFrame, docs: DataFrame, text: str = "text", least: float = JACCARD) -> DataFrame:
    """prints with class_id: the least doc_id of all documents connected by links (copies included)."""
    tree = written(near_classes(prints, docs, text, least), "classes")
    each = prints.groupBy("rid").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    rooted = each.join(tree, "rid", "left").filter("root is not null or n > 1").select("rid", "low", F.coalesce("root", "rid").alias("root"))
    rooted = written(rooted, "rooted")
    least_of = rooted.groupBy("root").agg(F.min("low").alias("class"))
    named = written(rooted.join(least_of, "root").select(F.col("rid").alias("r"), "class"), "named")
    side = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    out = prints.join(side, F.col("rid") == F.col("r"), "left")
    return out.withColumn("class_id", F.when(F.col("r").isNull(), F.col("doc_id")).otherwise(F.col("class"))).drop("r", "class")


def own_prints(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, rid and fp of every document, by one map."""
    picked = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("rid"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binaries(in_chunks(texts))], names=[key, "rid", "fp"])

    return picked.mapInArrow(run, f"{key} long, rid long, fp binary")


def others(rows: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row__") -> DataFrame:
    """Row numbers of all but one row of every class of near duplicates: the one with the least key (nulls last), then row, stays."""
    ids = rows.select(F.col(row).alias("n__"), F.col(key).alias("k__"))
    prints = written(own_prints(rows, row, text), "prints")
    tree = written(near_classes(prints, rows, text), "classes")
    rooted = prints.select(F.col(row).alias("n"), "rid").join(tree, "rid", "left").select("n", F.coalesce("root", "rid").alias("root"))
    each = written(rooted.join(ids, F.col("n") == F.col("n__")).select("n", "root", F.struct(F.col("k__").isNull(), "k__", "n").alias("rank")), "ranks")
    best = written(each.groupBy(F.col("root").alias("r")).agg(F.min("rank").alias("best"), F.count("*").alias("size")).filter("size > 1").select("r", "best"), "best")
    return each.join(best, F.col("root") == F.col("r")).filter(F.col("n") != F.col("best.n")).select(F.col("n").alias(row))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = with_classes(fingerprinted(docs), docs)
    lower = lambda c: F.lower(F.hex(c))
    return made.select("doc_id", "n_chars", lower("sha").alias("edited_sha256"), lower("fp").alias("fingerprint"), lower("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
