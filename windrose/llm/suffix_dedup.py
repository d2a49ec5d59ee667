"""Removal of long repeated byte strings by a distributed difference-cover algorithm.

Positions of each text whose remainder by ``PERIOD`` lies in a difference cover are sampled: whatever the distance of two
equal strings, one of any ``PERIOD`` successive offsets in them is sampled in both. A sampled position is named by the
``TUPLE`` bytes that begin there. Names go to buckets by range, are sorted there, and neighbours are compared. Then
names are made of names: a triple of them, ``PERIOD`` apart, covers any start of the ``PERIOD`` positions from the first
on, so a triple that occurs twice settles all of those. What remains are starts before a repeated name that no repeated
triple settles, some hundred bytes at the edges of a repeat. They are merged with the settled ones, of which the first
occurrence of each triple stands for all: strings of ``LENGTH`` bytes are named at both, sorted and compared once more.

Names are 64-bit fingerprints, so equal strings are named alike wherever they lie and no ranks have to be sent around; two
given strings that differ share a name with probability 2**-64. A block of texts sends each name to its bucket once,
with a mark if the block holds it twice, so no name is hot however often it occurs. Replies are bitmaps.

A null text is empty. Texts of fewer than ``LENGTH`` bytes keep everything; matches never cross texts. Repeated rows are
repeated texts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, mix, prefix_sums, span_hash, text_chunks, written

LENGTH, PERIOD = 400, 183
# A difference cover of 183, every remainder is the difference of two of them.
COVER = np.array([0, 1, 3, 31, 45, 50, 56, 65, 77, 125, 143, 147, 160, 176])
#: Bytes that a name stands for: within any LENGTH bytes, it follows any offset below PERIOD. A triple spans 584 bytes,
#: LENGTH from each of its first PERIOD positions.
TUPLE = LENGTH - PERIOD + 1
#: Text bytes whose names meet in one bucket, and the least number of buckets as a power of 2.
BUCKET_BYTES, LEAST_BITS = 256 << 20, 8
ZSTD_LEVEL = 3
TUPLES, TRIPLES, STRINGS = 0, 1, 2

UNITS = "doc_ids array<bigint>, ends binary, payload binary, n_bytes bigint"
SENT = "bucket int, kind int, block bigint, n int, names binary, twice binary"
REPLY = "block bigint, kind int, bucket int, n int, repeated binary, first binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def units(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks of whole texts with a number; written."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in text_chunks(batch, "text"):
            payload = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(data.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[lo:hi].to_pylist()], pa.list_(pa.int64())), pa.array([offsets[1:].tobytes()]), pa.array([payload]), pa.array([len(data)])], names=["doc_ids", "ends", "payload", "n_bytes"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(map_arrow(rows, run, UNITS).withColumn("block", F.monotonically_increasing_id()), "units")


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Names:
    """The distinct names of one kind in a block, and where they are."""

    def __init__(self, names: np.ndarray) -> None:
        self.distinct, self.first_at, self.of, self.times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)

    def sent(self, kind: int, block: int, bits: int) -> Iterator[tuple]:
        """Rows of ``SENT``: a bucket's names as differences."""
        bucket = (self.distinct >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = self.distinct[a:b]
            yield int(bucket[a]), kind, block, b - a, _planes(np.diff(part, prepend=np.uint64(0))), np.packbits(self.times[a:b] > 1).tobytes()

    def answered(self, replies: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """By position: whether its name is repeated; and the places whose name occurs here first of all."""
        bits: list[list[np.ndarray]] = [[], []]
        for r in sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["bucket"]):
            for out, raw in zip(bits, (r["repeated"], r["first"]), strict=True):
                out.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=r["n"]).astype(bool))
        repeated, first = (np.concatenate([np.zeros(0, bool), *b]) for b in bits)
        return repeated[self.of], self.first_at[first & repeated]


class Block:
    """The texts of a row of ``units``, its sampled positions and their names."""

    def __init__(self, row: dict) -> None:
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"]), np.uint8) if row["n_bytes"] else np.zeros(0, np.uint8)
        self.edges = np.r_[0, np.frombuffer(row["ends"], np.int64)]
        size = np.diff(self.edges)
        reach = size - TUPLE
        count = np.where(size >= LENGTH, reach // PERIOD * len(COVER) + np.searchsorted(COVER, reach % PERIOD, "right"), 0)
        doc = np.repeat(np.arange(len(size)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        self.start, self.end = self.edges[doc], self.edges[doc + 1]
        self.at = self.start + k // len(COVER) * PERIOD + COVER[k % len(COVER)]
        self.sums = prefix_sums(self.data)
        names = span_hash(self.sums, self.at, self.at + TUPLE)
        #: The name a period on is one round of the cover later.
        step = len(COVER)
        self.triple = np.flatnonzero(k + 2 * step < count[doc])
        self.tuples = Names(names)
        self.triples = Names(mix(mix(mix(names[self.triple]) + names[self.triple + step]) + names[self.triple + 2 * step]))

    def _marked(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        steps = np.bincount(low, minlength=len(self.data) + 1) - np.bincount(high, minlength=len(self.data) + 1)
        return np.cumsum(steps)[:-1] > 0

    def starts(self, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(settled, places to name once more): starts of strings, by byte and as positions."""
        repeated, _ = self.tuples.answered(replies, TUPLES)
        low = np.maximum(self.at - (PERIOD - 1), self.start)[repeated]
        possible = self._marked(low, np.minimum(self.at, self.end - LENGTH)[repeated] + 1)
        again, first = self.triples.answered(replies, TRIPLES)
        at = self.at[self.triple]
        settled = self._marked(at[again], at[again] + PERIOD)
        return settled, np.flatnonzero(possible & ~settled | self._marked(at[first], at[first] + PERIOD))

    def strings(self, places: np.ndarray) -> Names:
        return Names(span_hash(self.sums, places, places + LENGTH))

    def covered(self, starts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(starts)
        return self._marked(at, at + LENGTH)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in SENT.split(", ")])


def compared(table: pa.Table) -> pa.Table:
    """The replies of one bucket to every block: which of its names are repeated, and which occur there first."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    size = np.array([r["n"] for r in rows])
    names = np.concatenate([np.cumsum(_unplanes(r["names"]), dtype=np.uint64) for r in rows])
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]) for r in rows])
    order = np.argsort(names, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(names[order]) != 0])
    times = np.diff(np.r_[new, len(order)])
    repeated, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeated[order] = np.repeat((times > 1) | (np.add.reduceat(twice[order].astype(np.int64), new) > 0), times)
    first[order[new]] = True
    cut = np.cumsum(size)[:-1]
    out = {"block": [r["block"] for r in rows], "kind": [r["kind"] for r in rows], "bucket": [r["bucket"] for r in rows], "n": size.tolist(), "repeated": [np.packbits(x).tobytes() for x in np.split(repeated, cut)], "first": [np.packbits(x).tobytes() for x in np.split(first, cut)]}
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("repeated", pa.binary()), ("first", pa.binary())]))


def answered(sent: DataFrame) -> DataFrame:
    """The replies, one row for each block; written."""
    replies = sent.groupBy("bucket", "kind").applyInArrow(compared, REPLY)
    return written(replies.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "n", "repeated", "first")).alias("replies")), "replies")


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with its size, the bytes and runs that are removed, and the bytes that are kept."""
    blocks = units(docs, text, doc_id)
    total = blocks.agg(F.sum("n_bytes").alias("n")).first().n or 0
    bits = max(LEAST_BITS, (total // BUCKET_BYTES).bit_length())

    def sampled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            block = Block(row)
            yield _rows([*block.tuples.sent(TUPLES, row["block"], bits), *block.triples.sent(TRIPLES, row["block"], bits)])

    def remaining(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            block = Block(row)
            _, places = block.starts(row["replies"] or [])
            yield _rows([*block.strings(places).sent(STRINGS, row["block"], bits)])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            block = Block(row)
            starts, places = block.starts(row["replies"] or [])
            repeated, _ = block.strings(places).answered(row["more"] or [], STRINGS)
            starts[places[repeated]] = True
            gone = block.covered(starts)
            sums, edges = np.r_[0, np.cumsum(gone)], block.edges
            begins = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
            inner = edges[(edges > 0) & (edges < len(gone))]
            begins[inner] = gone[inner]
            runs = np.r_[0, np.cumsum(begins)]
            kept, removed = block.data[~gone].tobytes(), np.diff(sums[edges])
            ends = (edges - sums[edges]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(edges)), pa.array(removed), pa.array(np.diff(runs[edges])), pa.array([kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=[c.split()[0] for c in RESULT.split(", ")])

    first = answered(map_arrow(blocks, sampled, SENT))
    known = blocks.join(first, "block", "left")
    second = answered(map_arrow(known, remaining, SENT))
    return map_arrow(known.join(second.withColumnRenamed("replies", "more"), "block", "left"), cut, RESULT)


#: The same rows; on large tables it would take too much memory.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, i, hash(b[i + 1 : i + 400]) AS k FROM (SELECT r, b, unnest(range(0, n - 399)) AS i FROM d)),
m AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM m),
s AS (SELECT r, min(i) AS low, max(i) + 400 AS high FROM g GROUP BY r, g),
c AS (SELECT r, low, high, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low) AS before FROM s),
k AS (SELECT r, sum(high - low)::BIGINT AS gone, count(*) AS spans, string_agg(hex(b[before + 1 : low]), '' ORDER BY low) || hex(any_value(b)[max(high) + 1 : ]) AS kept FROM c JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
