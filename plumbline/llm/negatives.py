"""Hard-negative mining by dual-tree search over anchors and candidates.

For each anchor: its positives are the `positives` (5) best other rows of its label; for each of
them, the `negatives` (3) best rows of another label whose score lies between 50 % and 95 % of
the positive's. Scores are integer inner products; ties go to the smaller id.

Candidates are dealt into blocks of about BLOCK rows that lie near each other: a tree over a
bounded sample (SAMPLE rows, those with the least hash) gives cells, every row is put into its
cell, and a cell of many rows is split over several blocks, so no block grows with the
input or with a crowd of equal vectors. Each block holds its rows in the order of a tree of
its own. Anchors are searched in waves of about WAVE: the stated query set against all rows. A
wave's vectors, a proven size, go to every task with a tree over them; the blocks stay where
they are and are read once a pass, two passes a wave (positives, then negatives, which need the
positives' scores).

Inside a task the two trees are descended together: an inner-product interval of each node
pair comes from the nodes' boxes and, as a second bound, from their centres and radii. A pair is
dropped, a whole anchor group at once, if its interval lies below what every anchor in the
group has found or needs, or above all its bands. Leaf pairs that remain are scored exactly, the
most promising first. Equal scores are never pruned, since a smaller id may win.

Each task hands over what it keeps of each anchor (at most 5 rows, or 3 a positive), whatever
it has read; the final ranks are taken over those.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no
part; a null id is no anchor, comes last in ties, and is returned as null; repeated rows are
rows of their own: a repeated anchor is searched once a row and may have its twin as a
positive; where scores and ids tie, the order is that of the rows' numbers, which differ in
nothing returned; shorter vectors are filled up with zeros; positives of negative score have
no negatives (50 % of it is more than 95 %); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import exact_type, extent, integers, matrix, usable

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
SAMPLE, CELLS, BLOCK, WAVE = 16_384, 512, 4096, 32_768
ANCHOR_LEAF, BLOCK_LEAF = 32, 128
NEVER = -(1 << 62)


class Tree:
    """A binary tree over the rows of a matrix: node i of depth d covers rows n*i >> d to n*(i+1) >> d of `order`.

    Every depth keeps the boxes, centres and radii of its nodes.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(x)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        self.order = split(x, label, self.depth) if order is None else order
        y = x[self.order].astype(np.float64)
        self.rows = y
        self.bounds = [np.array([n * i >> d for i in range((1 << d) + 1)]) for d in range(self.depth + 1)]
        self.low, self.high, self.centre, self.radius = [], [], [], []
        for b in self.bounds:
            lo, hi = np.minimum.reduceat(y, b[:-1]), np.maximum.reduceat(y, b[:-1])
            c = np.rint(np.add.reduceat(y, b[:-1]) / np.diff(b)[:, None])
            far = np.sqrt(((y - np.repeat(c, np.diff(b), axis=0)) ** 2).sum(axis=1))
            self.low.append(lo)
            self.high.append(hi)
            self.centre.append(c)
            self.radius.append(np.maximum.reduceat(far, b[:-1]) * (1 + 1e-9))

    def reduce(self, op: np.ufunc, values: np.ndarray) -> list[np.ndarray]:
        """op over the rows of each node, depth by depth; values are in tree order."""
        return [op.reduceat(values, b[:-1]) for b in self.bounds]


def split(x: np.ndarray, label: np.ndarray, depth: int) -> np.ndarray:
    """An order of the rows in which a node's halves have lower and higher labels or, in a node of one label, lie on either side along a line through two rows far apart."""
    n, order = len(x), np.arange(len(x))
    for d in range(depth):
        for i in range(1 << d):
            a, b = n * i >> d, n * (i + 1) >> d
            mid = n * (2 * i + 1) >> (d + 1)
            if mid <= a or mid >= b:
                continue
            part = order[a:b]
            along = label[part]
            if along.min() == along.max():
                y = x[part].astype(np.float64)
                along = y @ direction(y)
            order[a:b] = part[np.argpartition(along, mid - a)]
    return order


def direction(y: np.ndarray) -> np.ndarray:
    """A line through two rows far apart: the farthest from the mean, and the farthest from that."""
    p = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    q = y[((y - p) ** 2).sum(axis=1).argmax()]
    return p - q


def intervals(a: Tree, i: np.ndarray, da: int, c: Tree, j: np.ndarray, dc: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of nodes i of a's depth da with nodes j of c's depth dc."""
    la, ha, lc, hc = a.low[da][i], a.high[da][i], c.low[dc][j], c.high[dc][j]
    p, q, r, s = la * lc, la * hc, ha * lc, ha * hc
    low, high = np.minimum(np.minimum(p, q), np.minimum(r, s)).sum(axis=1), np.maximum(np.maximum(p, q), np.maximum(r, s)).sum(axis=1)
    ca, cc, ra, rc = a.centre[da][i], c.centre[dc][j], a.radius[da][i], c.radius[dc][j]
    mid = (ca * cc).sum(axis=1)
    off = np.sqrt((ca * ca).sum(axis=1)) * rc + np.sqrt((cc * cc).sum(axis=1)) * ra + ra * rc
    slack = 1 + 1e-9 * (np.abs(mid) + off)
    return np.maximum(low, mid - off - slack), np.minimum(high, mid + off + slack)


def leaf_pairs(a: Tree, c: Tree, need: list[np.ndarray], most: list[np.ndarray] | None, fits, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs whose interval reaches `need` of the anchors' node and starts no higher than `most`, and their upper bounds.

    fits(da, i, dc, j) tells which node pairs may hold a pair of the labels asked for.
    """
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while stack:
        da, dc, i, j = stack.pop()
        if len(i) > step:
            stack += [(da, dc, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
            continue
        low, high = intervals(a, i, da, c, j, dc)
        keep = (high >= need[da][i]) & fits(da, i, dc, j)
        if most is not None:
            keep &= low <= most[da][i]
        i, j, high = i[keep], j[keep], high[keep]
        if not len(i):
            continue
        if da == a.depth and dc == c.depth:
            out.append((i, j, high))
            continue
        # The tree with more depth left goes down one step; at the same depth left, the candidates'.
        if c.depth - dc >= a.depth - da:
            i, j, dc = np.repeat(i, 2), (2 * j[:, None] + np.arange(2)).ravel(), dc + 1
        else:
            i, j, da = (2 * i[:, None] + np.arange(2)).ravel(), np.repeat(j, 2), da + 1
        stack.append((da, dc, i, j))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, high = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(-high, kind="stable")
    return i[order], j[order], high[order]


class Kept:
    """The k best (score, id, row) of each slot, by score, then smaller id (null last), then row."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))
        self.last = np.full(slots, NEVER, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        slot, score, ident, uid = (np.concatenate(x) for x in zip((self.slot, self.score, self.id, self.uid), (slot, score, ident, uid), strict=True))
        order = np.lexsort((uid, ident, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        order = order[keep]
        self.slot, self.score, self.id, self.uid = slot[keep], score[order], ident[order], uid[order]
        full = rank[keep] == self.k - 1
        self.last[self.slot[full]] = self.score[full]


NO_ID = np.iinfo(np.int64).max


def mined(blocks: DataFrame, wave: dict[str, np.ndarray], width: int, kind: type, bands: tuple[np.ndarray, np.ndarray] | None, k: int) -> DataFrame:
    """slot, score, id, uid: what every task keeps for the wave's slots.

    Without bands, a slot is an anchor and takes rows of its label; with bands (low and high, one
    row of positives for each anchor), a slot is an anchor's positive and takes rows of other
    labels with low <= score <= high.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(wave["x"], wave["label"], ANCHOR_LEAF)
        order = tree.order
        x, label, uid = wave["x"][order].astype(kind), wave["label"][order], wave["uid"][order]
        n, per = len(order), 1 if bands is None else bands[0].shape[1]
        low, high = (None, None) if bands is None else (b[order] for b in bands)
        most = None if bands is None else tree.reduce(np.maximum, high.max(axis=1))
        kept = Kept(n * per, k)
        kinds = sorted_labels(tree, label)
        for b in batches:
            for row in range(len(b)):
                got = {f: np.frombuffer(b.column(b.schema.get_field_index(f))[row].as_py(), t) for f, t in (("x", np.int32), ("label", np.int64), ("ids", np.int64), ("uids", np.int64))}
                c = Tree(got["x"].reshape(len(got["ids"]), width), got["label"], BLOCK_LEAF, np.arange(len(got["ids"])))
                y, theirs = c.rows.astype(kind), sorted_labels(c, got["label"])
                fits = (lambda da, i, dc, j: same_label(kinds, theirs, da, i, dc, j)) if bands is None else (lambda da, i, dc, j: other_label(kinds, theirs, da, i, dc, j))

                def needed() -> np.ndarray:  # the least score that each anchor still wants
                    last = kept.last.reshape(n, per)
                    return (last if bands is None else np.where(low <= high, np.maximum(low, last), -NEVER)).min(axis=1)

                i, j, top = leaf_pairs(tree, c, tree.reduce(np.minimum, needed()), most, fits)
                at = 0
                while at < len(i):
                    # The first pairs raise what is needed most; so their chunks are short.
                    end = min(len(i), at + (32 if at < 128 else 512))
                    want = np.minimum.reduceat(needed(), tree.bounds[-1][:-1])
                    found: list[tuple[np.ndarray, ...]] = []
                    for g, h, t in zip(i[at:end].tolist(), j[at:end].tolist(), top[at:end].tolist(), strict=True):
                        if t < want[g]:
                            continue
                        a0, a1, c0, c1 = tree.bounds[-1][g], tree.bounds[-1][g + 1], c.bounds[-1][h], c.bounds[-1][h + 1]
                        s = x[a0:a1] @ y[c0:c1].T
                        equal = label[a0:a1, None] == got["label"][None, c0:c1]
                        if bands is None:
                            r, q = np.nonzero(equal & (s >= kept.last[a0:a1, None]) & (uid[a0:a1, None] != got["uids"][None, c0:c1]))
                            slot = a0 + r
                            found.append((slot, s[r, q].astype(np.int64), got["ids"][c0 + q], got["uids"][c0 + q]))
                        else:
                            last = kept.last.reshape(n, per)
                            for m in range(per):
                                r, q = np.nonzero(~equal & (s >= np.maximum(low[a0:a1, m], last[a0:a1, m])[:, None]) & (s <= high[a0:a1, m, None]))
                                found.append(((a0 + r) * per + m, s[r, q].astype(np.int64), got["ids"][c0 + q], got["uids"][c0 + q]))
                    if found:
                        kept.add(*(np.concatenate(z) for z in zip(*found, strict=True)))
                    at = end
        slot = order[kept.slot // per] * per + kept.slot % per
        for a in range(0, len(slot), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(v[part]) for v in (slot, kept.score, kept.id, kept.uid)], names=["slot", "score", "id", "uid"])

    return blocks.select("x", "label", "ids", "uids").mapInArrow(run, "slot long, score long, id long, uid long")


def sorted_labels(tree: Tree, label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return tree.reduce(np.minimum, label), tree.reduce(np.maximum, label)


def same_label(a: tuple, c: tuple, da: int, i: np.ndarray, dc: int, j: np.ndarray) -> np.ndarray:
    """Node pairs whose ranges of labels meet."""
    return (a[0][da][i] <= c[1][dc][j]) & (c[0][dc][j] <= a[1][da][i])


def other_label(a: tuple, c: tuple, da: int, i: np.ndarray, dc: int, j: np.ndarray) -> np.ndarray:
    """Node pairs that are not of one label altogether."""
    return ~((a[0][da][i] == a[1][da][i]) & (c[0][dc][j] == c[1][dc][j]) & (a[0][da][i] == c[0][dc][j]))


def top_cells(sample: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and thresholds of each depth of a tree with that many cells (a power of two) over a sample."""
    n, out = len(sample), []
    y, node = sample.astype(np.float64), np.zeros(len(sample), np.int64)
    while (1 << len(out)) < cells and n >= 2 << len(out):
        lines, cuts = np.zeros((1 << len(out), y.shape[1])), np.zeros(1 << len(out))
        for i in range(1 << len(out)):
            mine = y[node == i]
            if len(mine):
                lines[i] = direction(mine)
                cuts[i] = np.median(mine @ lines[i])
        out.append((lines, cuts))
        node = 2 * node + ((y * lines[node]).sum(axis=1) > cuts[node])
    return out


def blocked(rows: DataFrame, width: int) -> DataFrame:
    """x, label, ids, uids: one row for each block of candidates that lie near each other, in the order of the block's tree."""
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("uid"), "uid").select("v").limit(SAMPLE).collect()
    steps = top_cells(np.stack([np.frombuffer(r.v, np.int32) for r in sample]) if sample else np.zeros((0, width)), min(CELLS, count // BLOCK + 1))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("v")), np.int32, width).astype(np.float64)
            node = np.zeros(len(x), np.int64)
            for lines, cuts in steps:
                node = 2 * node + ((x * lines[node]).sum(axis=1) > cuts[node])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], names=[*b.schema.names, "cell"])

    placed = written(rows.mapInArrow(cell, "uid long, id long, label long, v binary, cell long"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))

    def block(t: pa.Table) -> pa.Table:
        x = matrix(t.column("v"), np.int32, width)
        label = t.column("label").to_numpy()
        order = split(x, label, max(0, int(np.ceil(np.log2(len(x) / BLOCK_LEAF)))))
        one = {"x": x[order], "label": label[order], "ids": t.column("id").to_numpy()[order], "uids": t.column("uid").to_numpy()[order]}
        return pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in one.items()})

    return dealt.groupBy("cell", "part").applyInArrow(block, "x binary, label binary, ids binary, uids binary")


def hard_negatives(
    vectors: DataFrame, anchors: str = "vec_id % 50 = 0", key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, wave: int = WAVE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchors` is a condition on the rows."""
    picked = vectors.select(F.col(key).cast("long").alias(key), F.col(label).cast("long").alias(label), F.col(vector).alias(vector), F.coalesce(F.expr(anchors), F.lit(False)).alias("is_anchor"))
    kept = picked.filter(usable(F.col(vector)) & F.col(label).isNotNull())
    width, far = extent(kept, vector)
    kind = exact_type(max(1, width), far)
    width = max(1, width)
    named = kept.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(key), F.lit(int(NO_ID))).alias("id"), F.col(label).alias("label"), "is_anchor", F.col(vector).alias("x"))
    rows = written(integers(named, "x", width), "vectors")
    blocks = written(blocked(rows.drop("is_anchor"), width), "blocks")
    asked = rows.filter("is_anchor")
    waves = asked.count() // wave + 1
    spark, out = vectors.sparkSession, []
    for w in range(waves):
        mine = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(waves)) == w).select("uid", "id", "label", "v").toArrow()
        n = len(mine)
        if not n:
            continue
        held = {"x": matrix(mine.column("v"), np.int32, width), "label": mine.column("label").to_numpy(), "uid": mine.column("uid").to_numpy()}
        best = ranked(mined(blocks, held, width, kind, None, positives), positives).toArrow()
        slot, rank = best.column("slot").to_numpy(), best.column("rank").to_numpy() - 1
        score, ident = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
        there = np.zeros((n, positives), bool)
        score[slot, rank], ident[slot, rank], there[slot, rank] = best.column("score").to_numpy(), best.column("id").to_numpy(), True
        low = np.where(there, -(-LEAST * score // 100), 0)  # least integer at or above half
        high = np.where(there, MOST * score // 100, -1)
        found = ranked(mined(blocks, held, width, kind, (low, high), negatives), negatives)
        at = np.flatnonzero(there.ravel())
        pairs = spark.createDataFrame(pa.table({"slot": at, "anchor_id": np.repeat(mine.column("id").to_numpy(), positives)[at], "positive_id": ident.ravel()[at], "positive_score": score.ravel()[at]}))
        told = found.join(pairs, "slot")
        real = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
        out.append(written(told.select("anchor_id", real("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = spark.createDataFrame([], schema)
    for o in out:
        result = result.unionByName(o)
    return result


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each slot over all tasks, with their rank from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


ORACLE = """
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (SELECT a, r, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= 5)
SELECT p.a AS anchor_id, p.r AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.s DESC, n.r) AS INTEGER) AS rank, n.r AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.s DESC, n.r) <= 3
"""
