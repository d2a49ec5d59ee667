"""Helpers shared by the training-data operators: written tables, flat text buffers, vectorised words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text and rows that one vectorised step takes at a time; a longer single text is one step by itself.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1 << 15

#: Hashes are polynomials modulo the prime 2**61 - 1, at one of two fixed points drawn at random.
_PRIME, _BITS = np.uint64((1 << 61) - 1), np.uint64(61)
_POINTS = (0x0D3A6F1C95B2E847, 0x17C4E85A2B9F603D)
_LOW31, _LOW30, _31, _30, _1 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(31), np.uint64(30), np.uint64(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="windrose-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    #: What was shuffled for the table goes once it is written: nothing reads it again.
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them) of consecutive rows; null counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = min(lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    inside = np.zeros(256, bool)
    inside[ord("0") : ord("9") + 1] = inside[ord("a") : ord("z") + 1] = inside[ord("A") : ord("Z") + 1] = True
    inside[128:] = True
    return lower, inside


#: Byte to its lower case; whether a byte belongs to a word (digits, Latin letters, anything beyond ASCII).
LOWER, WORD_BYTE = _tables()

def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers that are the same modulo the prime, and above it by 7 at most."""
    return (x & _PRIME) + (x >> _BITS)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = _folded(x)
    return np.subtract(x, _PRIME, out=x, where=x >= _PRIME)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Folded products of folded numbers, by halves of 31 bits, as 2**61 counts as 1."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = ah * bl + al * bh
    return _folded(((ah * bh) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + al * bl)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime."""
    return _reduced(_times(a, b))


def _table(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base``."""
    have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), int(_PRIME)))
        have = np.concatenate([have, _product(have[: n - len(have)], np.full(min(len(have), n - len(have)), step))])
    return have


#: By point: the low 31 bits of its powers, and the rest; powers of its inverse, and of that one's INVERSES-th power.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_inverse_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
INVERSE_BITS = 12
INVERSES = 1 << INVERSE_BITS


def _power(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if point not in _powers or len(_powers[point][0]) < n:
        have = _table(_POINTS[point], max(n, 1 << 16) if n <= 1 << 16 else max(n, CHUNK_BYTES + 1))
        _powers[point] = (have & _LOW31).astype(np.uint32), (have >> _31).astype(np.uint32)
    return tuple(x[:n] for x in _powers[point])


def _inverse_power(point: int, exponent: np.ndarray) -> np.ndarray:
    """The inverse of the point to the power of each exponent, as a product of two."""
    most = int(exponent.max(initial=0)) // INVERSES + 1
    if point not in _inverse_powers or len(_inverse_powers[point][1]) < most:
        inverse = pow(_POINTS[point], -1, int(_PRIME))
        _inverse_powers[point] = _table(inverse, INVERSES), _table(pow(inverse, INVERSES, int(_PRIME)), max(most, 1024))
    small, large = _inverse_powers[point]
    return _times(small[exponent & INVERSES - 1], large[exponent >> INVERSE_BITS])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, point: int = 0) -> np.ndarray:
    """Running sums, with a leading 0, of the terms of the values' polynomial; span hashes are read off with ``span_hash``.

    Low 31 bits and the rest are added up apart, as the sums of whole terms would not fit. Differences stay right when a sum
    wraps, for spans of up to 2**25 bytes or any number of wider values.
    """
    (low, high), sums = _power(point, len(values)), np.zeros((2, len(values) + 1), np.uint64)
    if values.dtype == np.uint8:
        values = values.astype(np.uint64) + np.uint64(1)
        np.cumsum(values * low, out=sums[0, 1:])
        np.cumsum(values * high, out=sums[1, 1:])
    else:
        terms = _times(_folded(mix(values)), (high.astype(np.uint64) << _31) | low)
        np.cumsum(terms & _LOW31, out=sums[0, 1:])
        np.cumsum(terms >> _31, out=sums[1, 1:])
    return sums


def _spans(low: np.ndarray, high: np.ndarray, start: np.ndarray, point: int) -> np.ndarray:
    #: Times 2**31 is a turn by 31 of 61 bits.
    low, high = _folded(low), _folded(high)
    value = _folded(low + ((high & _LOW30) << _31) + (high >> _30))
    return mix(_product(value, _inverse_power(point, start)))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, point: int = 0) -> np.ndarray:
    """Hash of each [start, end), the same wherever the span lies; unlike spans of n values meet with probability n / 2**61."""
    return _spans(sums[0][end] - sums[0][start], sums[1][end] - sums[1][start], start, point)


def byte_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, point: int = 0) -> np.ndarray:
    """``span_hash`` of spans of bytes, with the sums of one half of the terms held at a time."""
    values, buffer, parts = data.astype(np.uint64), np.zeros(len(data) + 1, np.uint64), []
    values += np.uint64(1)
    for power in _power(point, len(data)):
        np.multiply(values, power, out=buffer[1:])
        np.cumsum(buffer[1:], out=buffer[1:])
        parts.append(buffer[end] - buffer[start])
    del values, buffer
    return _spans(*parts, start, point)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, row) of every word of the rows, lower-cased (A-Z); a word never crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[edge - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return byte_spans(LOWER[data], start, end), start, np.searchsorted(offsets[1:], start, "right")
