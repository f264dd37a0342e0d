"""Shared helpers of the training-data operators: scratch tables, Arrow chunks, let-binding."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts that speak of white space: 20, 09-0D.
WHITE_RE = r"[\x20\x09-\x0D]+"
#: Separators of the contracts whose words are ASCII letters, digits and everything beyond ASCII.
PUNCT_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and one JVM does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(scratch_dir, "own", None):
        scratch_dir.own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(lambda: __import__("shutil").rmtree(scratch_dir.own.removeprefix("file://"), ignore_errors=True))
    return scratch_dir.own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there and a lost executor costs nothing.

    The tables go when the driver process ends, or before by `release`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/plumbline-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete written tables that only other written tables were made from."""
    for t in tables:
        _delete(t.sparkSession, t._plumbline_path)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; nothing depends on this
            return


def let(df: DataFrame, *keep: str, **bound: Column) -> DataFrame:
    """Select keep and the bound columns, evaluated once a row.

    A lambda that names a projected column may get that column's whole expression
    inlined and run again for every element; a Generate in between stops this.
    """
    made = F.struct(*[c.alias(k) for k, c in bound.items()])
    return df.select(*keep, F.explode(F.array(made)).alias("_let")).select(*keep, *[F.col(f"_let.{k}").alias(k) for k in bound])


def packed(docs: DataFrame, made: tuple[str, ...], keep: list[str] | None = None) -> tuple[list[str], Column]:
    """Names to keep (default: all but those an operator makes, in any case), and their columns as one struct.

    Packed as `row__`, the input's columns cannot clash with an operator's own while it works.
    """
    taken = {m.lower() for m in made}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    return names, F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_"))


def unpacked(names: list[str]) -> list[Column]:
    return [F.col(f"row__.`{c}`").alias(c) for c in names]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def white_words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_RE), "")


def text_chunks(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes of text: first row, last row + 1, UTF-8 bytes, row offsets within them.

    A row is never cut; null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(name))
    n = len(col)
    if not n:
        return
    col = col.fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if len(_powers.get("p", ())) <= n:
        size = 1 << int(n).bit_length()
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, base in (("p", _P), ("i", inv)):
                x = np.full(size + 1, base, np.uint64)
                x[0] = 1
                np.multiply.accumulate(x, out=x)
                _powers[k] = x
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits both spread."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_table(white: bool) -> np.ndarray:
    """Byte -> lower-cased byte plus one where it belongs to a word, 0 where it separates."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    if white:
        t[[9, 10, 11, 12, 13, 32]] = 0
    else:
        t[:48] = 0
        t[58:65] = 0
        t[91:97] = 0
        t[123:128] = 0
    return t


def hashed_words(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows of a chunk: row of each, its start and end byte, its 64-bit hash."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    m = table[raw]
    word = m != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inv = powers(n)
    with np.errstate(over="ignore"):
        acc = np.empty(n + 1, np.uint64)
        acc[0] = 0
        np.cumsum(m * p[:n], out=acc[1:])
        h = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.searchsorted(off, s, "right") - 1, s, e, h


def pairs_of(n: int, k: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(n), k))


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    x, size = h, 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    d = w - size
    return np.minimum(x[: len(x) - d], x[d:]) if d and len(x) > d else x if not d else x[:0]
