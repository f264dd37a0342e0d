"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation many times, each snapshot a prefix of the next. Every
conversation gets a rolling hash of its turn prefixes; one whose whole hash is the hash of a
proper prefix of another is a snapshot and goes by an anti-join; of equal conversations the
least conv_id stays. What remains is rendered with role markers.

The rolling hash of k turns is the polynomial of their 128-bit digests modulo 2**127 - 1, so
it can be carried on from any point: turns, as digests without texts, are range-partitioned
in order, even within one conversation; each task rolls on from zero and hands over the
count and hash it ends with; these, one row a task, are added up on the driver, and a
conversation that crosses tasks is shifted by what came before. So turns cost linear time,
and a conversation of any length is no single task's.

Both sides of the anti-join are distinct hashes with least ids, taken by partial
aggregation. Texts are shuffled twice: repeated rows are made one, and the turns of kept
conversations meet for rendering, in parts of `PART_TURNS` turns, so a row of output is
bounded; nearly every conversation is one part, number 0.

Edge cases: turns are ordered by turn, then role, then the text's MD5, nulls first; a
repeated row counts once; a null role renders as `unknown` and a null text as nothing, yet
nulls and empty strings stay different turns; a row with a null conv_id belongs to no other
and is a conversation of its own; markers inside texts are broken up, so a text cannot open
a turn; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the rendered form.
OPEN, CLOSE, MARK, BROKEN = "<|im_start|>", "<|im_end|>\n", "<|", "< |"
PART_TURNS = 1000
_PRIME, _BASE = (1 << 127) - 1, 0x2F0E1D3C4B5A69788796A5B4C3D2E1F
#: A conversation: its id; for a row without one, its digest.
KEY = ["conv_id", "alone"]
PLACES = "conv_id long, alone string, at string, k long, h binary, last boolean, part int, head boolean, tail boolean"


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(BROKEN)), F.lit(CLOSE))


def _roll(h: int, digest: str) -> int:
    return (h * _BASE + int(digest, 16) + 1) % _PRIME


def _bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, alone, at, digest) in order -> PLACES: each row's number and prefix hash within this task's share of its conversation.

    head: the task's first conversation; tail: the task's last row.
    """
    part, key, head, was_head, k, h, held = TaskContext.get().partitionId(), None, True, True, 0, 0, None
    names = [x.split()[0] for x in PLACES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        out = []
        for c, a, at, d in zip(*(x.to_pylist() for x in b.columns), strict=True):
            new = key != (c, a)
            if held is not None:
                out.append((*held, new, part, was_head, False))
                head = head and not new
            if new:
                key, k, h = (c, a), 0, 0
            k, h = k + 1, _roll(h, d)
            held, was_head = (c, a, at, k, _bytes(h)), head
        if out:
            yield batch(out)
    if held is not None:
        yield batch([(*held, False, part, was_head, True)])


def _carried(rolled: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """What each task's first conversation brings from before (turns, hash), and whether the task's last row ends its conversation."""
    ends = rolled.filter("tail").select(*KEY, "k", "h", "part", "head").collect()
    firsts = {r.part: (r.conv_id, r.alone) for r in rolled.filter("head and k = 1").select(*KEY, "part").collect()}
    out, key, k, h = {}, None, 0, 0
    order = sorted(ends, key=lambda r: r.part)
    for i, r in enumerate(order):
        goes_on = firsts[r.part] == key
        base = (k, h) if goes_on else (0, 0)
        whole = r.head  # the task holds one conversation only
        own = int.from_bytes(r.h, "big")
        if whole:
            k, h = base[0] + r.k, (base[1] * pow(_BASE, r.k, _PRIME) + own) % _PRIME
        else:
            k, h = r.k, own
        key = (r.conv_id, r.alone)
        out[r.part] = (*base, i + 1 == len(order) or firsts[order[i + 1].part] != key)
    return out


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, alone, at, k (turns so far), h (their rolling hash), last, for distinct turns (conv_id, alone, turn, role, md5, at, digest)."""
    spark = turns.sparkSession
    order = [F.col(c).asc_nulls_first() for c in (*KEY, "turn", "role", "md5")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rolled = written(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*KEY, "at", "digest").mapInArrow(_rolled, PLACES), "rolled")
    carried = _carried(rolled)
    brought = {p: (k, h) for p, (k, h, _) in carried.items() if k}

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [brought[p] for p in b.column("part").to_pylist()]
            own = b.column("k").to_pylist()
            h = [_bytes((hb * pow(_BASE, k, _PRIME) + int.from_bytes(x, "big")) % _PRIME) for (_, hb), k, x in zip(rows, own, b.column("h").to_pylist(), strict=True)]
            new = {"k": pa.array([k + kb for (kb, _), k in zip(rows, own, strict=True)], pa.int64()), "h": pa.array(h, pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], names=b.schema.names)

    closing = [p for p, (_, _, ends) in carried.items() if ends]
    crossing = F.col("head") & F.col("part").isin(list(brought)) if brought else F.lit(False)
    moved = rolled.filter(crossing).mapInArrow(shift, PLACES).unionByName(rolled.filter(~crossing))
    ended = F.col("last") | (F.col("tail") & F.col("part").isin(closing)) if closing else F.col("last")
    return moved.select(*KEY, "at", "k", "h", ended.alias("last"))


def maximal_chats(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), rendered, of every conversation that no longer one starts with."""
    said = F.concat(F.coalesce(F.concat(F.lit("r"), "role"), F.lit("-")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-")))
    each = turns.select("conv_id", "turn", "role", "text").withColumns({"md5": F.md5(F.col("text").cast("binary")), "digest": F.substring(F.sha2(said, 256), 1, 32)})
    each = each.withColumn("alone", F.when(F.col("conv_id").isNull(), F.concat_ws(" ", F.col("turn").cast("string"), "digest")))
    # A turn's own name within its conversation, by which its text finds its place again.
    each = each.withColumn("at", F.md5(F.concat_ws(" ", F.col("turn").cast("string"), "digest").cast("binary")))
    places = written(prefixes(each.select(*KEY, "turn", "role", "md5", "at", "digest").distinct()), "prefixes")
    whole = places.filter("last").groupBy("h").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "alone", "k")).alias("least"))
    inner = places.filter("not last").select("h").distinct()
    kept = whole.join(inner, "h", "left_anti").select(F.col("least.conv_id").alias("c"), F.col("least.alone").alias("a"), F.col("least.k").alias("n_turns"))
    here = places.join(kept, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("alone").eqNullSafe(F.col("a"))).select("c", "a", "n_turns", F.col("at").alias("t"), "k")
    texts = each.groupBy(*KEY, "at", "role").agg(F.max("text").alias("text"))
    found = texts.join(written(here, "kept"), F.col("conv_id").eqNullSafe(F.col("c")) & F.col("alone").eqNullSafe(F.col("a")) & (F.col("at") == F.col("t")))
    part = ((F.col("k") - 1) / part_turns).cast("int")
    shown = found.select(*KEY, "n_turns", part.alias("part"), F.struct("k", _rendered(F.col("role"), F.col("text")).alias("r")).alias("x"))
    out = shown.groupBy(*KEY, "part", "n_turns").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return out.select("conv_id", "part", "n_turns", F.array_join(F.transform("x", lambda y: y["r"]), "").alias("rendered"))


def op7_chat(spark, sf_dir: str) -> DataFrame:
    return maximal_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = rf"""
with turns as (
  select distinct conv_id, turn, role, text, case when conv_id is null then concat_ws('|', turn, coalesce('r' || role, '-'), coalesce('t' || text, '-')) end as alone from conversations),
grown as (
  select conv_id, alone, turn,
    string_agg(coalesce('r' || role, '-') || chr(31) || coalesce('t' || text, '-') || chr(30), '') over w as prefix,
    '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) as rendered,
    row_number() over w as k, count(*) over (partition by conv_id, alone) as n_turns
  from turns window w as (partition by conv_id, alone order by turn nulls first, role nulls first, md5(text) nulls first)),
kept as (
  select q.c as conv_id, q.a as alone from (
    select min(struct_pack(n := conv_id is null, c := conv_id, a := alone)) as q from grown where k = n_turns and prefix not in (select prefix from grown where k < n_turns) group by prefix))
select g.conv_id, (k - 1) // {PART_TURNS} as part, any_value(n_turns) as n_turns, string_agg(rendered, '' order by k) as rendered
from grown g join kept q on g.conv_id is not distinct from q.conv_id and g.alone is not distinct from q.alone
group by g.conv_id, g.alone, part
"""
