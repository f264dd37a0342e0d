"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, one of the target documents and one of all others, share one
vocabulary, one smoothing and one layout; a document's score is the mean over its tokens of the
target model's loss minus the background model's. Low scores look like the target. The models
are matched: the background's counts are those of all its documents, scaled so that both models
hold as many tokens. A document's own counts are left out of the model that holds it while it is
scored, so a score does not tell whether the document was among the target's.

Words, contexts and pairs are items of 63 bits, each with its own counts: the vocabulary is
as large as the corpus makes it, and nothing is folded into fewer classes (two items meet by
chance only, at 1e9 items about once in twenty corpora). Documents are dealt into chunks by a
hash of the row and its number, so that repeated rows spread. A chunk hands over each of its distinct items once, with its counts, to the
shard of the item's range; the shard sums and answers each chunk in the order it was asked;
the chunk scores its documents from the answers. So a hot item is one entry a chunk, no model
is held in one place, and chunks and shards grow in number with the corpus, not in size. The
counts cover every token of every document. The answers are written once; only one row of
sums a shard reaches the driver.

Target documents are found by joining labels; the labelled ids are broadcast up to
`broadcast_ids` rows, counted first, and joined by a shuffle beyond.

Edge cases: null and blank texts have no tokens, losses and a score of 0; documents with
several labels are target if any says so; null ids are never target; repeated rows count
and are scored each, by models that hold the others; with no target documents the target model is uniform over the seen
vocabulary; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, hashed_words, mix, text_chunks, written

#: Bytes of text of a chunk and entries of a shard, about; the least number of each, for small inputs.
CHUNK_BYTES, SHARD_ITEMS, LEAST = 5 << 20, 2 << 20, 64
#: Added counts: of the uniform word distribution, and of the word model in the pair model.
ALPHA, MU = 0.5, 8.0
BROADCAST_IDS = 1_000_000
TABLE = byte_table(white=True)
START = np.uint64(0x9AE16A3B2F90404F)
ONE = np.uint64(1)


def classes(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item of each word, of the word before it as a context (the start of a text is a word), and of the pair; words alone are odd."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.flatnonzero(np.diff(doc, prepend=-1))] = START
    with np.errstate(over="ignore"):
        pair = mix(before * np.uint64(0xFF51AFD7ED558CCD) + h)
        context = mix(before + np.uint64(0xC2B2AE3D27D4EB4F))
    return h | ONE, context & ~ONE, pair & ~ONE


def items(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each token, the distinct items in order, and where each token's word, context and pair are among them."""
    rows, found, base = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.uint64)], 0
    for b in docs.select(["text"]).to_batches():
        for lo, _, raw, off in text_chunks(b, "text"):
            doc, _, _, h = hashed_words(raw, off, TABLE)
            if len(h):
                rows.append(base + lo + doc)
                found.append(np.stack(classes(doc, h)))
        base += len(b)
    distinct, at = np.unique(np.concatenate(found, axis=1), return_inverse=True)
    return np.concatenate(rows), distinct, at.reshape(3, -1)


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte position, compressed without loss: most counts, and steps between items, are small."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def asked(docs: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, items, target, every: each chunk's distinct items of each shard's range, with its own counts."""
    edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)

    def run(t: pa.Table) -> pa.Table:
        row, distinct, at = items(t)
        wanted = np.asarray(t.column("wanted").to_numpy(), bool)[row]
        every = np.bincount(at.ravel(), minlength=len(distinct))
        target = np.bincount(at[:, wanted].ravel(), minlength=len(distinct))
        ends = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < b]
        n = len(parts)
        return pa.table({
            "shard": pa.array([k for k, _, _ in parts], pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()] * n, pa.int32()),
            "items": pa.array([planes(np.diff(distinct[a:b], prepend=np.uint64(0))) for _, a, b in parts], pa.binary()),
            "target": pa.array([planes(target[a:b]) for _, a, b in parts], pa.binary()), "every": pa.array([planes(every[a:b]) for _, a, b in parts], pa.binary()),
        })

    return docs.groupBy("chunk").applyInArrow(run, "shard int, chunk int, items binary, target binary, every binary")


def answers(entries: DataFrame) -> DataFrame:
    """chunk, shard, target, every: the corpus's counts in the order asked; with a null chunk, a shard's sums (words, their counts)."""

    def run(t: pa.Table) -> pa.Table:
        each = [np.cumsum(unplaned(x.as_py()).view(np.uint64), dtype=np.uint64) for x in t.column("items")]
        distinct, at = np.unique(np.concatenate(each), return_inverse=True)
        ends = np.cumsum([len(x) for x in each])[:-1]
        word = (distinct & ONE) == ONE
        out, sums = {}, [int(word.sum())]
        for name in ("target", "every"):
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, np.concatenate([unplaned(x.as_py()) for x in t.column(name)]))
            sums.append(int(total[word].sum()))
            out[name] = pa.array([*map(planes, np.split(total[at], ends)), None], pa.binary())
        shard, n = t.column("shard")[0].as_py(), len(each)
        made = {"chunk": pa.array([*t.column("chunk").to_pylist(), None], pa.int32()), "shard": pa.array([shard] * (n + 1), pa.int32()), **out}
        return pa.table(made | {k: pa.array([None] * n + [v], pa.int64()) for k, v in zip(("words", "n_target", "n_every"), sums, strict=True)})

    return entries.groupBy("shard").applyInArrow(run, "chunk int, shard int, target binary, every binary, words long, n_target long, n_every long")


def scores(docs: DataFrame, is_target: DataFrame, key: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score; is_target has the target documents' ids in its first column."""
    ids = is_target.select(F.col(is_target.columns[0]).cast("long").alias("t")).filter("t is not null").distinct()
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(max(LEAST, size // CHUNK_BYTES + 1))).cast("int")
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    flagged = picked.withColumn("chunk", chunk).join(side, F.col("doc_id") == F.col("t"), "left").select("chunk", "doc_id", "text", F.col("t").isNotNull().alias("wanted"))
    # About one entry for two bytes: six bytes a token, three items a token, nearly all of them distinct.
    found = written(answers(asked(flagged, max(LEAST, size // 2 // SHARD_ITEMS + 1))), "counts")
    sums = found.filter("chunk is null").agg(*[F.sum(c).alias(c) for c in ("words", "n_target", "n_every")]).first()
    vocabulary, n_target = max(1, sums.words or 0), sums.n_target or 0
    n_rest = (sums.n_every or 0) - n_target
    scale = n_target / n_rest if n_rest else 0.0

    def run(t: pa.Table, got: pa.Table) -> pa.Table:
        row, distinct, at = items(t)
        n, size = len(t), np.bincount(row, minlength=len(t))
        wanted = np.asarray(t.column("wanted").to_numpy(), bool)[row]
        order = np.argsort(got.column("shard").to_numpy())
        count = {}
        for name in ("target", "every"):
            parts = got.column(name)
            count[name] = np.concatenate([np.zeros(0, np.int64), *[unplaned(parts[int(i)].as_py()) for i in order]])
            assert len(count[name]) == len(distinct)
        # How often a token's word, context and pair occur in its own document.
        place, own = np.unique(at + row * len(distinct), return_inverse=True)
        own = np.bincount(own.ravel(), minlength=len(place))[own].reshape(at.shape)
        means = {}
        for name, counts, held, tokens, times in (("target", count["target"], wanted, n_target, 1.0), ("rest", count["every"] - count["target"], ~wanted, n_rest, scale)):
            word, context, pair = (counts[at] - own * held) * times
            p = (word + ALPHA) / ((tokens - size[row] * held) * times + ALPHA * vocabulary)
            loss = -np.log((pair + MU * p) / (context + MU))
            means[name] = np.bincount(row, weights=loss, minlength=n) / np.maximum(size, 1)
        lt, lb = means["target"], means["rest"]
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": size.astype(np.int64), "loss_target": lt, "loss_background": lb, "score": lt - lb})

    told = found.filter("chunk is not null").select("chunk", "shard", "target", "every")
    schema = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
    return flagged.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
