"""Vector code compression: product codes by Hamerly's bounded Lloyd iteration.

Vectors are cut into `parts` (16) equal consecutive parts; each part position has a codebook
of up to `entries` (64) integer vectors, started from the rows with the smallest ids. A round
assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index)
and replaces each entry by the floored mean of its parts. After `rounds` (2), parts are
assigned once more.

Each row carries, for every part, its entry, an upper bound of the distance to it and a lower
bound of the distance to the second nearest, persisted with the row between rounds. When
the entries move, the upper bound grows by its entry's step and the lower one shrinks by the
largest step of any other. A part whose upper bound stays strictly below the lower one (or
below half the way from its entry to the nearest other entry) keeps its entry: no other
is as near, so no tie can be missed. Else the upper bound is made exact and the test is
repeated, and only if it fails again are all entries scanned, in exact integers. Bounds are
doubles, rounded outwards by a relative SLACK far above their rounding error.

Every round is one map over the written rows: no row is shuffled. Each task adds one row of
sums and counts of its parts, as large as the codebooks; the sums are added in Spark, and
the codebooks (entries x width integers, whatever the input) are all that the driver holds.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped;
fewer than 64 rows give as many entries; repeated rows count each; rows of one id are
ordered by their packed components when the first entries are chosen, null ids last; vectors are
filled up with zeros to the longest, and to a multiple of 16; null labels are one label;
an empty table gives an empty result; extra columns are ignored by op13 and kept by
`compress` unless they bear its names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, release, unpacked, written
from .vectors import binaries, exact_type, extent, integers, matrix, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SLACK = 1e-9
BROADCAST_ROWS = 1_000_000
#: Rows of a step of the exact scan, so that its table of distances stays small.
STEP = 4096
SUMS = pa.list_(pa.int64())
MADE = ("code", "error", "full_scans")


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (lowest index at ties), its squared distance and that of the second nearest, exactly."""
    n, k = len(x), len(book)
    near, best, second = np.zeros(n, np.uint8), np.zeros(n, x.dtype), np.zeros(n, np.float64)
    norm = (book * book).sum(axis=1)
    for a in range(0, n, STEP):
        y = x[a : a + STEP]
        d = norm - 2 * (y @ book.T)
        d += (y * y).sum(axis=1)[:, None]
        j = d.argmin(axis=1)
        i = np.arange(len(y))
        near[a : a + STEP], best[a : a + STEP] = j, d[i, j]
        if k > 1:
            d = d.astype(np.float64)
            d[i, j] = np.inf
            second[a : a + STEP] = d.min(axis=1)
        else:
            second[a : a + STEP] = np.inf
    return near, best, second


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds of one part of all rows after its entries moved by `moved`; how many rows were scanned in full."""
    k = len(book)
    last = np.argsort(moved)[::-1][:2]
    others = np.where(np.arange(k) == last[0], moved[last[-1]] if k > 1 else 0.0, moved[last[0]])
    upper = (upper + moved[near]) * (1 + SLACK)
    lower = (lower - others[near]) * np.where(lower > others[near], 1 - SLACK, 1 + SLACK)
    if k > 1:
        gap = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
        np.fill_diagonal(gap, np.inf)
        half = np.sqrt(gap.min(axis=1)) / 2 * (1 - SLACK)
    else:
        half = np.full(k, np.inf)
    held = np.maximum(lower, half[near])
    open_ = np.flatnonzero(~(upper < held))
    exact = ((x[open_] - book[near[open_]]) ** 2).sum(axis=1)
    upper[open_] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < held[open_])]
    near = near.copy()
    if len(open_):
        j, best, second = scan(x[open_], book)
        near[open_], upper[open_], lower[open_] = j, np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
    return near, upper, lower, len(open_)


def _assigned(rows: DataFrame, books: np.ndarray, width: int, kind: type, moved: np.ndarray | None, final: bool) -> DataFrame:
    """One pass: rows with their codes and bounds anew (final: with code and error), and one row of sums a task (null v)."""
    parts, k, w = books.shape
    keep = ["row__", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, row_type = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64), None
        for b in batches:
            row_type = b.column(0).type
            n = len(b)
            x = matrix(b.column(1), np.int32, width).reshape(n, parts, w)
            code, up, low, scans = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros(n, np.int32)
            error = np.zeros(n, np.int64)
            if moved is not None:
                had, had_up, had_low = matrix(b.column(2), np.uint8, parts), matrix(b.column(3), np.float64, parts), matrix(b.column(4), np.float64, parts)
            for p in range(parts):
                y, book = np.ascontiguousarray(x[:, p]).astype(kind), books[p].astype(kind)
                if moved is None:
                    near, best, second = scan(y, book)
                    up[:, p], low[:, p] = np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
                    scanned = n
                else:
                    near, up[:, p], low[:, p], scanned = reassign(y, book, moved[p], had[:, p], had_up[:, p].copy(), had_low[:, p].copy())
                code[:, p] = near
                scans[:1] += scanned
                if final:
                    error += ((y - book[near]) ** 2).sum(axis=1).astype(np.int64)
                else:
                    counts[p] += np.bincount(near, minlength=k)
                    for c in range(w):
                        sums[p, :, c] += np.rint(np.bincount(near, weights=y[:, c], minlength=k)).astype(np.int64)
            if final:
                yield pa.RecordBatch.from_arrays([b.column(0), binaries(code), pa.array(error), pa.array(scans)], names=["row__", "code", "error", "scans"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binaries(code), binaries(up), binaries(low), pa.nulls(n, SUMS)], names=[*keep, "code", "upper", "lower", "sums"])
        if not final and row_type is not None:
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, row_type), none, none, none, none, pa.array([np.concatenate([sums.ravel(), counts.ravel()])], SUMS)], names=[*keep, "code", "upper", "lower", "sums"])

    row = rows.schema["row__"].dataType.simpleString()
    if final:
        return rows.mapInArrow(run, f"row__ {row}, code binary, error long, scans int")
    return rows.mapInArrow(run, f"row__ {row}, v binary, code binary, upper binary, lower binary, sums array<long>")


def _totals(told: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over all tasks: as many rows as the codebooks have numbers reach the driver."""
    total = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for r in told.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        total[r.pos] = r.n
    sums, counts = np.split(total, [shape[0] * shape[1] * shape[2]])
    return sums.reshape(shape), counts.reshape(shape[:2])


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The kept rows with code (one byte a part), error, and full_scans; and the codebooks (parts, entries, components).

    full_scans: of the last assignment, how many parts of a batch's rows were scanned in full (told on its first row).
    """
    kept = vectors.filter(usable(F.col(vector)))
    width, far = extent(kept, vector)
    w = max(1, -(-width // parts))
    kind = exact_type(w * parts, far)
    names, row = packed(vectors, (*MADE, vector))
    state = written(integers(kept.select(F.struct(F.col(key).alias("key"), row.alias("row")).alias("row__"), F.col(vector).alias("x")), "x", w * parts), "vectors")
    first = state.orderBy(F.col("row__.key").asc_nulls_last(), F.hex("v")).limit(entries).select("v").collect()
    books = np.stack([np.frombuffer(r.v, np.int32) for r in first]).reshape(len(first), parts, w).transpose(1, 0, 2).astype(np.int64) if first else np.zeros((parts, 1, w), np.int64)
    moved = None
    for _ in range(rounds):
        told = written(_assigned(state, books, w * parts, kind, moved, final=False), "codes")
        release(state)
        sums, counts = _totals(told.filter("sums is not null"), books.shape)
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)
        books, state = new, told.filter("sums is null").select("row__", "v", "code", "upper", "lower")
        state._plumbline_path = told._plumbline_path
    done = _assigned(state, books, w * parts, kind, moved, final=True)
    return done.select(*[c.alias(n) for c, n in ((F.col(f"row__.row.`{n}`"), n) for n in names)], "code", "error", F.col("scans").alias("full_scans")), books if first else books[:, :0]


def book_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    coded, books = compress(rows)
    out = written(coded, "coded")
    sums = written(out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "labels")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    told = out.join(side, F.col("label").eqNullSafe(F.col("l")))
    return told.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book_hash(books)).alias("codebooks_sha256"))


#: Kept vectors as integers, cut into parts; three assignments with two updates between, all distances formed.
_NEAR = """
{n}d AS (SELECT r.part, r.rid, b.entry, list_sum(list_transform(list_zip(r.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM parts r JOIN {b} b USING (part)),
{n} AS (SELECT part, rid, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM {n}d GROUP BY part, rid)"""
_MOVE = """
{b} AS (SELECT o.part, o.entry, coalesce(m.x, o.x) AS x FROM {a} o LEFT JOIN (
  SELECT part, entry, list(y ORDER BY i) AS x FROM (SELECT n.part, n.entry, i, CAST(floor(CAST(sum(r.x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM {n} n JOIN parts r USING (part, rid), range(1, 5) t(i) GROUP BY n.part, n.entry, i) GROUP BY part, entry) m USING (part, entry))"""
ORACLE = f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM kept, range(16) t(part)),
b0 AS (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= 64),
{_NEAR.format(n="n1", b="b0")}, {_MOVE.format(b="b1", a="b0", n="n1")},
{_NEAR.format(n="n2", b="b1")}, {_MOVE.format(b="b2", a="b1", n="n2")},
{_NEAR.format(n="n3", b="b2")},
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n3 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (rid), book
"""
