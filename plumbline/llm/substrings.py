"""Exact removal of long repeated byte strings (400 bytes) across and within documents.

Every 400-byte window whose bytes also start anywhere else is repeated; a byte goes if a
repeated window covers it. What decides is equality of windows, found like this:

1. Anchors. Rolling polynomial hashes of all 64-byte grams are minimised over every window;
   the leftmost least gram is the window's anchor. Equal windows have their anchor at the
   same place, so only suffixes at anchors, one in about 170 bytes, need be compared.
   Consecutive windows with one anchor form a segment, and equal segments (128-bit hash
   over the bytes and the anchor's place) are repeated whole.
2. Suffix sort. Different segments that share an anchor gram meet by that gram. Their
   suffixes from the anchor, and the reversed prefixes up to it, are mergesorted; two are
   compared by their common extension, found by binary search over prefix polynomial
   hashes and verified byte by byte, so a comparison takes a logarithmic number of steps.
   The common extensions of neighbours split each order into classes at every depth; a
   window is repeated exactly if another segment shares both its classes.
3. Hot grams. More than `GROUP` different segments of one gram are not brought together:
   their extents are searched by halving in steps of eight, blocks of 64 windows, of 8, of
   one. A block whose whole stretch is hashed equal elsewhere is repeated; one whose common
   core (the bytes that all its windows share) stands nowhere else has no repeated window;
   only what is neither is cut into the next size. No pair of segments is ever listed.
   Equality is that of 128-bit XXH3 hashes over the bytes.

Counts are partial sums by hash, so a passage in a third of all documents is one row a task;
classes of equal stretches stay in the search by one representative. Joins back run on
written tables, where adaptive execution splits hot keys. Windows never cross documents.

Edge cases: null texts are empty; texts under 400 bytes lose nothing; repeated rows (id and
text) are reduced to one that counts twice, so they cost one row each; an empty table gives an empty result; extra columns are ignored.
Very long and periodic texts are handled whole in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, release, text_chunks, window_least, written
from .passages import shared_passages

LENGTH, GRAM = 400, 64
BLOCKS = (64, 8, 1)
#: Different segments of one anchor gram that one task sorts; grams with more are searched by counting.
GROUP = 128
#: Lists of places with up to this many entries in all (counted) are broadcast to the scan; more are joined by a shuffle.
BROADCAST_ENTRIES = 1_000_000
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte grams, by adding shifted halves; k is any positive number."""
    x, size, power = _BYTES[raw], 1, _BASE
    out, have = None, 0
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                if out is None:
                    out, have = x, size
                else:
                    n = min(len(out), len(x) - have)
                    out, have = (out[:n] * np.uint64(power) + x[have : have + n] if n > 0 else x[:0]), have + size
            k >>= 1
            if k:
                x = x[:-size] * np.uint64(power) + x[size:] if len(x) > size else x[:0]
                size, power = 2 * size, power * power % (1 << 64)
    return mix(out)


def segments(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """row, first window, last window, anchor (places in the chunk), anchor hash, of every segment of a chunk."""
    empty = np.zeros(0, np.int64)
    none = (empty, empty, empty, empty, np.zeros(0, np.uint64))
    if len(raw) < length:
        return none
    h, w = gram_hashes(raw, gram), length - gram + 1
    least = window_least(h, w)
    n = len(least)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    p = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size - length + 1, 0)) - np.maximum(size - length + 1, 0), np.maximum(size - length + 1, 0)) + off[row]
    if not len(p):
        return none
    v = least[p]
    starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (row[1:] != row[:-1])]))
    ends = np.append(starts[1:], len(p)) - 1
    a, b, r = p[starts], p[ends], row[starts]
    assert b.max() < n
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    q = np.concatenate([a[i : i + 4096] + view[a[i : i + 4096]].argmin(axis=1) for i in range(0, len(a), 4096)])
    tied = q < b
    if tied.any():  # the least value stands more than once: later windows of the run have a later anchor
        parts = [(r[~tied], a[~tied], b[~tied], q[~tied])]
        for rr, aa, bb, qq in zip(r[tied].tolist(), a[tied].tolist(), b[tied].tolist(), q[tied].tolist(), strict=True):
            same = np.flatnonzero(h[qq : bb + w] == h[qq]) + qq
            lo = np.concatenate([[aa], same[:-1] + 1])
            keep = lo <= bb
            lo, same = lo[keep], same[keep]
            parts.append((np.full(len(lo), rr), lo, np.minimum(same, bb), same))
        r, a, b, q = (np.concatenate(x) for x in zip(*parts, strict=True))
    return r, a, b, q, h[q]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """r1, r2: 128 bits that name a row by id and text; equal rows are copies in any case."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, t).alias("r1"), F.xxhash64(F.lit(1), t, key).alias("r2"), t.alias("text"))


def single(keyed: DataFrame) -> DataFrame:
    """Each row once, with m = 2 where it is repeated.

    Rows that stand alone stay where they are; of the repeated ones one text a key is shuffled.
    """
    again = written(keyed.groupBy(F.col("r1").alias("d1"), F.col("r2").alias("d2")).agg(F.count("*").alias("k")).filter("k > 1").select("d1", "d2"), "repeated_rows")
    n = again.count()
    if not n:
        return keyed.withColumn("m", F.lit(1))
    side, same = F.broadcast(again) if n <= BROADCAST_ENTRIES else again, (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2"))
    one = keyed.join(side, same, "left_semi").groupBy("r1", "r2").agg(F.max("text").alias("text"), F.lit(2).alias("m"))
    out = keyed.join(side, same, "left_anti").select("r1", "r2", "text", F.lit(1).alias("m")).unionByName(one)
    return out if n <= BROADCAST_ENTRIES else written(out, "rows")


def anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """r1, r2, m, ah, fk, lo, hi, at: the segments of all rows; lo and hi count from the row's first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            r1, r2, m = (batch.column(i).to_numpy() for i in range(3))
            for first, _, raw, off in text_chunks(batch, "text", 1 << 18):
                r, a, b, q, h = segments(raw, off, length, gram)
                if not len(r):
                    continue
                data = raw.tobytes()
                keys = [digest(data[x : y + length], ((z - x) << 32) | (y - x)) for x, y, z in zip(a.tolist(), b.tolist(), q.tolist(), strict=True)]
                o, rows = off[r], first + r
                cols = [pa.array(r1[rows]), pa.array(r2[rows]), pa.array(m[rows]), pa.array(h.view(np.int64)), pa.array(keys, pa.binary()), *[pa.array((x - o).astype(np.int64)) for x in (a, b, q)]]
                yield pa.RecordBatch.from_arrays(cols, names=["r1", "r2", "m", "ah", "fk", "lo", "hi", "at"])

    return keyed.select("r1", "r2", "m", "text").mapInArrow(run, "r1 long, r2 long, m int, ah long, fk binary, lo long, hi long, at long")


class Suffixes:
    """Segments of one batch with prefix polynomial hashes over their bytes."""

    def __init__(self, parts: list[bytes]):
        self.data = b"".join(parts)
        raw = _BYTES[np.frombuffer(self.data, np.uint8)]
        p, self.inverse = powers(len(raw))
        with np.errstate(over="ignore"):
            self.acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * p[: len(raw)])])
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).tolist()

    def hashed(self, s: int, e: int) -> int:
        return ((int(self.acc[e]) - int(self.acc[s])) * int(self.inverse[s])) & 0xFFFFFFFFFFFFFFFF

    def common(self, x: int, y: int, most: int, step: int) -> int:
        """Length of the common extension from places x and y, to the right (step 1) or to the left (-1)."""
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            a, b = (x, y) if step > 0 else (x - mid, y - mid)
            if self.hashed(a, a + mid) == self.hashed(b, b + mid):
                lo = mid
            else:
                hi = mid - 1
        a, b = (x, y) if step > 0 else (x - lo, y - lo)
        if self.data[a : a + lo] != self.data[b : b + lo]:  # hashes collided: compare the bytes
            n = 0
            while n < most and self.data[x + n if step > 0 else x - 1 - n] == self.data[y + n if step > 0 else y - 1 - n]:
                n += 1
            return n
        return lo


def sorted_classes(suf: Suffixes, anchor: list[int], room: list[int], step: int) -> tuple[list[int], list[int]]:
    """Order of a group's suffixes (or reversed prefixes) and the common extension of each with the one before it."""

    def compare(i: int, j: int) -> int:
        n = suf.common(anchor[i], anchor[j], min(room[i], room[j]), step)
        if n == min(room[i], room[j]):
            return room[i] - room[j]
        at = (lambda k: suf.data[anchor[k] + n]) if step > 0 else (lambda k: suf.data[anchor[k] - 1 - n])
        return at(i) - at(j)

    order = sorted(range(len(anchor)), key=cmp_to_key(compare))  # a mergesort
    lcp = [suf.common(anchor[i], anchor[j], min(room[i], room[j]), step) for i, j in zip(order, order[1:])]
    return order, lcp


def group_windows(suf: Suffixes, members: list[tuple[int, int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(member, least j, largest j) of repeated windows. Members: place of bytes, anchor's offset, least and largest j.

    Window j starts j bytes before the anchor: it is repeated if another member agrees on j bytes
    to the left and on length - j to the right.
    """
    anchor = [s + q for s, q, _, _ in members]
    left, right = [q for _, q, _, _ in members], [length - j0 for _, _, j0, _ in members]
    if len(members) == 2:
        a = suf.common(anchor[0], anchor[1], min(left), -1)
        b = suf.common(anchor[0], anchor[1], min(right), 1)
        return [(i, length - b, a) for i in (0, 1)] if length - b <= a else []
    lo, ll = sorted_classes(suf, anchor, left, -1)
    ro, rl = sorted_classes(suf, anchor, right, 1)
    ll_, rl_ = np.array(ll), np.array(rl)
    cuts = np.unique(np.concatenate([ll_ + 1, length - rl_, [min(j0 for _, _, j0, _ in members)]]))
    last = max(j1 for _, _, _, j1 in members)
    rank_l, rank_r = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
    rank_l[lo], rank_r[ro] = np.arange(len(lo)), np.arange(len(lo))
    out = []
    for k, j in enumerate(cuts.tolist()):
        end = int(cuts[k + 1]) - 1 if k + 1 < len(cuts) else last
        if j > last or end < j:
            continue
        cl = np.concatenate([[0], np.cumsum(ll_ < j)])[rank_l]
        cr = np.concatenate([[0], np.cumsum(rl_ < length - j)])[rank_r]
        _, inverse, count = np.unique(cl * len(lo) + cr, return_inverse=True, return_counts=True)
        out += [(i, j, end) for i in np.flatnonzero(count[inverse] > 1).tolist()]
    return out


def sorted_groups(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (ah, r1, r2, at, lo, hi, m, t) in order of ah -> r1, r2, s, e of what repeated windows of m = 1 cover."""

    def solve(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        # In slices of whole groups of about a quarter of a megabyte: hashes take many times the bytes.
        out, a, size = [], 0, 0
        for i, r in enumerate(rows):
            if size > 1 << 18 and r[0] != rows[i - 1][0]:
                out += solve_slice(rows[a:i])
                a, size = i, 0
            size += len(r[7])
        return out + solve_slice(rows[a:])

    def solve_slice(pending: list[tuple]) -> list[tuple[int, int, int, int]]:
        suf, out, i = Suffixes([r[7] for r in pending]), [], 0
        while i < len(pending):
            k = i
            while k < len(pending) and pending[k][0] == pending[i][0]:
                k += 1
            members = [(suf.start[n], r[3] - r[4], r[3] - r[5], r[3] - r[4]) for n, r in enumerate(pending[i:k], i)]
            for n, j0, j1 in group_windows(suf, members, length) if k - i > 1 else ():
                _, r1, r2, at, lo, hi, m, _ = pending[i + n]
                a, b = max(lo, at - j1), min(hi, at - j0)
                if m == 1 and a <= b:
                    out.append((r1, r2, a, b + length))
            i = k
        return out

    def batch(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["r1", "r2", "s", "e"])

    held: list[tuple] = []
    for b in rows:
        held += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:  # the last group may go on in the next batch
            cut -= 1
        yield batch(solve(held[:cut]))
        held = held[cut:]
    yield batch(solve(held))


def _cut(rows: Iterator[tuple], step: int, length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of `step` windows of (r1, r2, ah, at, lo, hi, m, bytes from lo on)."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    names, out = ["r1", "r2", "ah", "at", "lo", "hi", "m", "ck", "fk", "t"], []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for r1, r2, ah, at, lo, hi, m, data in rows:
        # Blocks are aligned to the anchor: window j = at - start.
        for block in range((at - hi) // step, (at - lo) // step + 1):
            j0, j1 = block * step, block * step + step - 1
            a, b = max(lo, at - j1), min(hi, at - j0)
            part = data[a - lo : b - lo + length]
            # The common core of the aligned block: from its last window's start to its first window's end.
            core = data[at - j0 - lo : max(at - j1 + length - lo, 0)] if step > 1 else part
            seed = (ah ^ (block * 0x9E3779B97F4A7C15) ^ step) & (2**63 - 1)
            out.append((r1, r2, ah, at, a, b, m, digest(core, seed), digest(part, seed ^ ((b - a) << 32) ^ ((at - a) << 48)) if step > 1 else b"", part))
            if len(out) >= 2000:
                yield batch()
                out = []
    if out:
        yield batch()


BLOCK = "r1 long, r2 long, ah long, at long, lo long, hi long, m int, ck binary, fk binary, t binary"


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """r1, r2, s, e: stretches of bytes of a row that repeated windows cover (they may overlap)."""
    keyed = single(_keyed(docs, key, text).drop("doc_id"))
    rid = F.xxhash64("r1", "r2", "at", "lo")
    each = written(anchors(keyed, length, gram), "anchors")
    classes = written(each.groupBy("ah", "fk").agg(F.sum("m").alias("n"), F.min(rid).alias("rep")), "segments")
    mixed = written(classes.groupBy("ah").agg(F.count("*").alias("d")).filter("d > 1").select(F.col("ah").alias("g"), "d"), "mixed")
    shared = classes.join(mixed, F.col("ah") == F.col("g"), "left").filter("n > 1 or g is not null")
    shared = written(shared.select(F.col("fk").alias("k"), "ah", "n", "rep", "d"), "shared")
    release(classes, mixed)
    found = each.drop("ah").join(shared, F.col("fk") == F.col("k"))
    found = written(found.select("r1", "r2", "ah", "at", "lo", "hi", "n", F.when(rid == F.col("rep"), F.col("d")).alias("d")).filter("n > 1 or d is not null"), "found")
    release(each, shared)
    covers = lambda df: df.select("r1", "r2", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    done = [covers(found.filter("n > 1"))]

    open_ = F.struct("ah", "at", "lo", "hi", F.least("n", F.lit(2)).cast("int").alias("m"), (F.col("d") > group).alias("hot"))
    lists = written(found.filter("d is not null").groupBy("r1", "r2").agg(F.collect_list(open_).alias("x")), "lists")
    hot = lists.withColumn("x", F.filter("x", lambda y: y["hot"])).filter(F.size("x") > 0)

    # Few enough different segments: sort them where they meet.
    cool = _joined(keyed, lists).select("r1", "r2", F.explode(F.filter("x", lambda y: ~y["hot"])).alias("y"), F.col("text").cast("binary").alias("b"))
    cool = cool.select("y.ah", "r1", "r2", "y.at", "y.lo", "y.hi", "y.m", F.substring(F.col("b"), F.col("y.lo").cast("int") + 1, (F.col("y.hi") - F.col("y.lo") + length).cast("int")).alias("t"))
    parts = cool.repartition("ah").sortWithinPartitions("ah")
    done.append(written(parts.mapInArrow(lambda rows: sorted_groups(rows, length), "r1 long, r2 long, s long, e long"), "sorted"))

    # Too many: search by counting.
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for r1, r2, x, t in zip(*(b.column(i) for i in range(4)), strict=True):
                    data = t.as_py()
                    for y in x.as_py():
                        yield r1.as_py(), r2.as_py(), y["ah"], y["at"], y["lo"], y["hi"], y["m"], data[y["lo"] : y["hi"] + length]

        return _cut(rows(), BLOCKS[0], length)

    def deeper(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _cut((tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(len(b))), step, length)

        return run

    state = _joined(keyed, hot).select("r1", "r2", "x", F.col("text").cast("binary").alias("text")).mapInArrow(first, BLOCK)
    for n, step in enumerate(BLOCKS):
        state = written(state, f"blocks{step}")
        core = written(state.groupBy(F.col("ck").alias("c")).agg(F.sum("m").alias("nc")).filter("nc > 1"), f"cores{step}")
        live = state.join(core, F.col("ck") == F.col("c")).drop("c")
        if step == 1:
            done.append(covers(live.filter("m = 1")))
            break
        live = written(live.withColumn("rid", rid), f"live{step}")
        stretch = written(live.groupBy(F.col("fk").alias("f")).agg(F.sum("m").alias("nf"), F.min("rid").alias("rep")).filter("nf > 1"), f"stretches{step}")
        both = written(live.join(stretch, F.col("fk") == F.col("f"), "left").withColumn("nf", F.coalesce("nf", F.lit(0).cast("long"))), f"judged{step}")
        done.append(covers(both.filter("m = 1 and nf > 1")))
        # What is open goes on; of equal stretches one goes on as a partner for the others.
        on = both.filter("nf < 2 or (rid = rep and nc > nf)").withColumn("m", F.when(F.col("nf") > 1, 2).otherwise(F.col("m")))
        release(state, live)
        state = on.select("r1", "r2", "ah", "at", "lo", "hi", F.col("m").cast("int").alias("m"), "t").mapInArrow(deeper(BLOCKS[n + 1]), BLOCK)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _joined(keyed: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    lists = lists.withColumnsRenamed({"r1": "l1", "r2": "l2"})
    side = F.broadcast(lists) if (lists.agg(F.sum(F.size("x"))).first()[0] or 0) <= BROADCAST_ENTRIES else lists
    return keyed.join(side, (F.col("r1") == F.col("l1")) & (F.col("r2") == F.col("l2")), how)


def kept_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """r1 (the row's key), doc_id, n_bytes, removed (maximal removed runs: start, end bytes), kept (remaining bytes) for every row."""
    spans = repeated(docs, key, text, length, gram, group).groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("x"))
    kind, run_type = dict(docs.dtypes)[key], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                runs: list[dict] = []
                for y in x:
                    if runs and y["s"] <= runs[-1]["e"]:
                        runs[-1]["e"] = max(runs[-1]["e"], y["e"])
                    else:
                        runs.append(y)
                out.append(runs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, run_type)], names=["r1", "r2", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Results leave by the few hundred rows: a batch of whole texts is held once, not three times over.
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
            n, removed, kept = [], [], []
            for x, t in zip(b.column(2), b.column(3), strict=True):
                data, runs = t.as_py(), x.as_py() or []
                at, left = 0, []
                for y in runs:
                    left.append(data[at : y["s"]])
                    at = y["e"]
                n.append(len(data))
                removed.append(runs)
                kept.append(b"".join([*left, data[at:]]))
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["r1", "doc_id", "n_bytes", "removed", "kept"])

    spans = written(spans.mapInArrow(merge, "r1 long, r2 long, x array<struct<s:bigint,e:bigint>>"), "spans")
    joined = _joined(_keyed(docs, key, text), spans, "left")
    return joined.select("r1", "doc_id", "x", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"r1 long, doc_id {kind}, n_bytes long, removed array<struct<s:bigint,e:bigint>>, kept binary")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = kept_texts(docs)
    out = out.select("r1", "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    # Passages of over 50 words may be shorter than 400 bytes: those stay, and are reported.
    shared = written(shared_passages(_keyed(docs, "doc_id", "text").select(F.col("r1").alias("rid"), "text")), "passages")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ENTRIES else shared
    out = out.join(side, F.col("r1") == F.col("rid"), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))
