"""Benchmark decontamination over a document-partitioned positional inverted index.

``build_index`` turns the corpus into a stored table: one row per block of documents, holding the block's sorted
terms and, for each, the sorted list of its token positions. ``search`` sends the benchmark's windows to every block:
it starts from the posting list of a window's rarest term and intersects it with the offset-adjusted lists of the
other terms, by binary search in the stored lists, rarest first. Survivors within ``slop`` positions are proximity
matches, those at the exact positions phrase matches. Blocks need no exchange, so no term or document can be hot.

Texts of any length are indexed whole. Nulls and texts without words have no postings and are never hit. Repeated documents are judged row by row. Items
without words have no windows; an item_id that is null marks words but is no listed item; repeated item_ids count once.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, text_chunks, words, written

WINDOW = 10
SLOP = 1
#: Text bytes of benchmark items that the driver holds at a time; more items are sent in more blocks, one after the other.
QUERY_BLOCK_BYTES = 4 << 20
#: Candidates that one step of an intersection holds.
STEP = 1 << 20

INDEX_SCHEMA = "block string, doc_ids array<bigint>, text_keys array<bigint>, starts binary, terms binary, bounds binary, postings binary"
#: What one block of items marks in one block of documents: spans as pairs of positions, and (document, item_id).
HIT_SCHEMA = "block string, exact array<int>, near array<int>, docs array<int>, ids array<string>"
RESULT_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint, text_key bigint"


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: the high planes hardly change and compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _index_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("starts", "terms", "bounds", "postings"))])
    for lo, hi, data, offsets in text_chunks(batch, "text"):
        term, _, row = words(data, offsets)
        order = np.argsort(term, kind="stable").astype(np.int32)
        ranked = term[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        starts = np.r_[0, np.cumsum(np.bincount(row, minlength=hi - lo))].astype(np.int32)
        values = [[uuid.uuid4().hex], [batch.column("doc_id")[lo:hi].to_pylist()], [batch.column("text_key")[lo:hi].to_pylist()], [starts.tobytes()], [_planes(ranked[first])], [_planes(np.r_[first, len(ranked)].astype(np.int32))], [_planes(order)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The positional inverted index of ``docs`` as a written table."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    return written(map_arrow(rows, _index_batch, INDEX_SCHEMA), "postings")


def query_windows(texts: list[str | None], width: int = WINDOW) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the distinct windows of the items, as rows of terms, and the items that they come from."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        terms = words(data, np.array([0, len(data)]))[0]
        if len(terms):
            w = np.lib.stride_tricks.sliding_window_view(terms, min(width, len(terms)))
            found.setdefault(w.shape[1], []).append((w, np.full(len(w), i)))
    return {n: (np.concatenate([w for w, _ in x]), np.concatenate([i for _, i in x])) for n, x in found.items()}


class _Block:
    """One row of the index."""

    def __init__(self, starts: bytes, terms: bytes, bounds: bytes, postings: bytes) -> None:
        self.starts = np.frombuffer(starts, np.int32).astype(np.int64)
        self.terms = _unplanes(terms, np.uint64)
        self.bounds = _unplanes(bounds, np.int32).astype(np.int64)
        self.postings = _unplanes(postings, np.int32).astype(np.int64)
        self.n = max(1, len(self.postings))
        #: Term number and position in one key, in ascending order: the lists of all terms one after the other.
        self.keys = np.repeat(np.arange(len(self.terms)) * self.n, np.diff(self.bounds)) + self.postings

    def occurs(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of each term has a position in [low, high]."""
        at = np.searchsorted(self.keys, term * self.n + low)
        return (low <= high) & (np.take(self.keys, at, mode="clip") <= term * self.n + high) & (at < len(self.keys))

    def match(self, windows: np.ndarray, items: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, item, exact) of the windows that occur within ``slop``."""
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, windows), len(self.terms) - 1)
        live = np.flatnonzero((self.terms[at] == windows).all(axis=1))
        at, items, width = at[live], items[live], windows.shape[1]
        count = self.bounds[at + 1] - self.bounds[at]
        by_rarity = np.argsort(count, axis=1, kind="stable")
        total = np.r_[0, np.cumsum(count.min(axis=1))] if len(at) else np.zeros(1, np.int64)
        for begin in range(0, int(total[-1]), STEP):
            k = np.arange(begin, min(begin + STEP, int(total[-1])))
            w = np.searchsorted(total, k, "right") - 1
            offset = by_rarity[w, 0]
            position = self.postings[self.bounds[at[w, offset]] + k - total[w]]
            doc = np.searchsorted(self.starts, position, "right") - 1
            start, first, last = position - offset, self.starts[doc], self.starts[doc + 1] - 1
            for j in range(1, width):
                offset = by_rarity[w, j]
                keep = self.occurs(at[w, offset], np.maximum(start + offset - slop, first), np.minimum(start + offset + slop, last))
                w, start, first, last = w[keep], start[keep], first[keep], last[keep]
            exact = (start >= first) & (start + width - 1 <= last)
            for j in range(width if slop else 0):
                exact &= self.occurs(at[w, j], start + j, start + j)
            yield np.maximum(start, first), np.minimum(start + width, last + 1), np.where(exact, items[w], -1 - items[w])

    def marked(self, query: tuple, slop: int) -> dict:
        """The row of ``HIT_SCHEMA`` of a block of items, without its block."""
        edges = np.zeros((2, len(self.postings) + 1), np.int32)
        named: set[tuple[int, str]] = set()
        ids, by_length = query
        for windows, items in by_length.values():
            for start, end, item in self.match(windows, items, slop):
                for k, chosen in ((0, item >= 0), (1, np.ones(len(item), bool))):
                    np.add.at(edges[k], start[chosen], 1)
                    np.add.at(edges[k], end[chosen], -1)
                exact = item >= 0
                for d, i in np.unique(np.stack([np.searchsorted(self.starts, start[exact], "right") - 1, item[exact]]), axis=1).T:
                    if ids[i] is not None:
                        named.add((int(d), ids[i]))
        inside = np.diff(np.cumsum(edges, axis=1) > 0, axis=1, prepend=False, append=False)
        return {"exact": np.flatnonzero(inside[0]).tolist(), "near": np.flatnonzero(inside[1]).tolist(), "docs": [d for d, _ in named], "ids": [x for _, x in named]}


def _judged(starts: np.ndarray, hits: list[dict]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words hit exactly and nearly, and the items, of each document of a block that ``hits`` mark."""
    named: list[set[str]] = [set() for _ in range(len(starts) - 1)]
    edges = np.zeros((2, int(starts[-1]) + 2), np.int32)
    for hit in hits:
        for k, spans in enumerate((hit["exact"], hit["near"])):
            np.add.at(edges[k], np.array(spans[::2], np.int64), 1)
            np.add.at(edges[k], np.array(spans[1::2], np.int64), -1)
        for d, x in zip(hit["docs"], hit["ids"], strict=True):
            named[d].add(x)
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(np.cumsum(edges, axis=1) > 0, axis=1)], axis=1)
    hit, near = sums[:, starts[1:]] - sums[:, starts[:-1]]
    return hit, near, named


def search(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Per indexed document the words hit by phrase matches and by proximity matches, and the items that occur."""
    spark = index.sparkSession
    items = written(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))

    def sent(k: int):  # noqa: ANN202
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        return spark.sparkContext.broadcast(([r.item_id for r in part], query_windows([r.text for r in part], width)))

    def judge(r: dict, hits: list[dict]) -> pa.RecordBatch:
        starts = np.frombuffer(r["starts"], np.int32).astype(np.int64)
        hit, near, named = _judged(starts, hits)
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named]
        return pa.RecordBatch.from_arrays(
            [pa.array(r["doc_ids"], pa.int64()), pa.array(np.diff(starts)), pa.array(hit), pa.array([len(x) for x in named], pa.int64()), pa.array(digest), pa.array(hit > 0), pa.array(near), pa.array(r["text_keys"], pa.int64())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "text_key"],
        )

    def marks(r: dict, query: tuple) -> dict:
        return _Block(r["starts"], r["terms"], r["bounds"], r["postings"]).marked(query, slop)

    if n == 1:
        query = sent(0)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in batch.to_pylist():
                yield judge(r, [marks(r, query.value)])

        return map_arrow(index, run, RESULT_SCHEMA)

    schema = pa.schema([("block", pa.string()), ("exact", pa.list_(pa.int32())), ("near", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("ids", pa.list_(pa.string()))])
    found = []
    for k in range(n):
        query = sent(k)

        def mark(batch: pa.RecordBatch, query=query) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for r in batch.to_pylist():
                if (hit := marks(r, query.value))["near"]:
                    yield pa.RecordBatch.from_pylist([{"block": r["block"], **hit}], schema)

        found.append(written(map_arrow(index, mark, HIT_SCHEMA), "hits"))
        #: The driver and the workers hold one block of items at a time.
        query.destroy()
    hits = reduce(DataFrame.unionByName, found).groupBy("block").agg(F.collect_list(F.struct("exact", "near", "docs", "ids")).alias("hits"))

    def gather(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            yield judge(r, r["hits"] or [])

    return map_arrow(index.select("block", "doc_ids", "text_keys", "starts").join(hits, "block", "left"), gather, RESULT_SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any phrase match, with the columns that they came with."""
    hit = search(build_index(docs), benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    on = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    return docs.join(hit, on, "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
