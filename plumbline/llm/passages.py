"""Documents that share a passage of over 50 words with another, by winnowed word windows.

A gram of 20 words (runs without white space, ASCII case aside) that is least in some window of
51 words of a row is an anchor. Equal windows hold the same anchors, so documents that share
51 consecutive words share an anchor, always; documents that share an anchor share its 20
words (by a 64-bit hash). What lies between may count or not.

1. One scan counts anchors by least and largest row key: those of several documents are
   shared. They set bits in a filter of fixed size (`FILTER_WORDS` longs, by bitwise or), the
   only thing that is broadcast; false positives cost work, never results.
2. A second scan hands over the anchors that pass the filter; a join with the shared ones
   leaves those, and a row's are counted.

Everything is a partial sum by hash, so a passage in a third of all documents is one row a
task, and a periodic text has few different anchors. Texts never move.

Edge cases: a document is an id with its text, so repeated rows are one document, and copies
of a text without ids too; null texts have no words; an empty table gives an empty result.
Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, hashed_words, text_chunks, window_least, written

WORDS, GRAM = 51, 20
FILTER_WORDS = 1 << 20
BROADCAST_ROWS = 1_000_000
TABLE = byte_table(white=True)
_MOST = np.uint64(2**64 - 1)
_ODD = [np.uint64(pow(0x9FB21C651E98DF25, i + 1, 1 << 64)) for i in range(GRAM)]


def anchors(doc: np.ndarray, h: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some window of one row; ties are all kept."""
    n, w = len(h) - words + 1, words - gram + 1
    if n < 1:
        return np.zeros(0, np.int64), h[:0]
    with np.errstate(over="ignore"):
        g = h[: n + w - 1] * _ODD[0]
        for i in range(1, gram):
            g = g + h[i : i + n + w - 1] * _ODD[i]
    # A gram is an anchor if the greatest of its windows' least hashes is its own.
    least = np.where(doc[words - 1 :] == doc[:n], ~window_least(g, w), _MOST)
    pad = np.full(w - 1, _MOST)
    at = np.flatnonzero(window_least(np.concatenate([pad, least, pad]), w) == ~g)
    return at, g[at]


def _anchored(keyed: DataFrame, words: int, gram: int, bits=None) -> DataFrame:
    """fp and rid: the different anchors of every row, those that pass the filter where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for first, _, raw, off in text_chunks(batch, "text", 1 << 18):
                doc, _, _, h = hashed_words(raw, off, TABLE)
                at, g = anchors(doc, h, words, gram)
                fp, row = g.view(np.int64), doc[at]
                if bits is not None:
                    held = (bits.value[(fp >> 6) % FILTER_WORDS] >> (fp & 63)) & 1 == 1
                    fp, row = fp[held], row[held]
                order = np.lexsort((fp, row))
                fp, row = fp[order], row[order]
                new = np.append(True, (fp[1:] != fp[:-1]) | (row[1:] != row[:-1]))[: len(fp)]
                yield pa.RecordBatch.from_arrays([pa.array(fp[new]), pa.array(rid[first + row[new]])], names=["fp", "rid"])

    return keyed.mapInArrow(run, "fp long, rid long")


def _filter(shared: DataFrame) -> np.ndarray:
    """Bits of the shared anchors: at most FILTER_WORDS rows reach the driver."""
    spot = shared.select(F.pmod(F.shiftright("fp", 6), F.lit(FILTER_WORDS)).alias("i"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("b"))
    rows = spot.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[rows.column("i").to_numpy()] = rows.column("b").to_numpy()
    return bits


def shared_passages(keyed: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """rid and n_shared, its different shared anchors, of the rows that have any; keyed: rid (a hash of id and text) and text."""
    counts = _anchored(keyed, words, gram).groupBy("fp").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    shared = written(counts.filter("lo <> hi").select(F.col("fp").alias("f")), "shared_anchors")
    bits = keyed.sparkSession.sparkContext.broadcast(_filter(shared.withColumnRenamed("f", "fp")))
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    held = _anchored(keyed, words, gram, bits).join(side, F.col("fp") == F.col("f"))
    return held.select("rid", "fp").distinct().groupBy("rid").agg(F.count("*").alias("n_shared"))
