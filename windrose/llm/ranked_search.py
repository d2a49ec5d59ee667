"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document is what one occurrence of it in a query adds to that document's score, before the term's own
weight. ``build_index`` stores, for blocks of documents, the postings of every term and their impacts as bit slices: one
bitmap over the postings for each bit of the impact. ``search`` works on whole bitmaps from there on. The slices of a
query's postings are multiplied by the term weights by shifting and adding, one 64-bit word of documents at a time; the
products are laid out over the block's documents and added up, term by term, by a ripple of exclusive-or and carries; and a
query's best documents are found from the most significant slice of the sums downwards, by intersecting bitmaps and counting
their ones. Only the best of each block leave it, so nothing is exchanged but k rows a block and query.

Blocks are consecutive documents of an input partition. A document of a block is a bit, whatever its length or number of
terms, so no term, document or copy can be hot. Corpus statistics are two numbers, document frequencies are summed for the
terms of the queries only.

A null text and one without terms are in no ranking, nor is a document that no weight lifts above 0. Repeated rows are ranked
each. A null doc_id comes before all others on ties. Items without terms, or whose terms no document holds, get no rows;
equal items count once, and unlike texts under one item_id, a null one too, are queries of their own. An empty table on
either side gives no rows, other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, text_chunks, words, written

TOP = 10
#: Fixed values of the score: impacts are SCALE * tf div (1000 * tf + 8 * m), m = 25 + (75 * n * N) div L.
SCALE, TF_PART, LENGTH_PART, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
#: Bits that hold any impact, as it is below SCALE / TF_PART.
IMPACT_BITS = 20
#: Text bytes of a block of documents (a longer text is a block by itself), text bytes of the queries that are sent at
#: once, bytes of the sums that a task holds at once.
BLOCK_BYTES, QUERY_BLOCK_BYTES, SUM_BYTES = 16 << 20, 4 << 20, 64 << 20

INDEX_SCHEMA = "doc_ids binary, terms binary, starts binary, ids binary, slices binary"
FOUND_SCHEMA = "query bigint, score bigint, doc_id bigint"
NO_ID = np.iinfo(np.int64).min


def _statistics(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo, hi, data, offsets in text_chunks(batch, "text"):
        n = np.bincount(words(data, offsets)[2], minlength=hi - lo)
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, with repeats."""
    rows = map_arrow(docs.select(F.col(text).cast("string").alias("text")), _statistics, "docs bigint, terms bigint")
    r = rows.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r.docs or 0, r.terms or 0


def _packed(bits: np.ndarray) -> np.ndarray:
    """The bits of the last axis in 64-bit words, the first bit lowest."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    wide = np.zeros((*raw.shape[:-1], -(-raw.shape[-1] // 8) * 8), np.uint8)
    wide[..., : raw.shape[-1]] = raw
    return wide.view(np.uint64)


def _unpacked(words_: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words_).view(np.uint8), axis=-1, count=n, bitorder="little")


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The index as a written table, one row for each block; and the number of documents with a term."""
    n_docs, n_terms = statistics(docs, text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _, _ in text_chunks(batch, "text", block_bytes):
            doc_ids = batch.column("doc_id")[lo:hi].fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            #: Documents of a block go by doc_id, so that of equal ones the first bits are the best.
            place = np.empty(hi - lo, np.int64)
            place[np.argsort(doc_ids, kind="stable")] = np.arange(hi - lo)
            #: A block is hashed in small steps, as hashing holds some thirty bytes for each byte of text.
            steps = [(term, row + first) for first, _, part, ends in text_chunks(batch.slice(lo, hi - lo), "text") for term, _, row in [words(part, ends)]]
            term, row = (np.concatenate(x) for x in zip(*steps, strict=True))
            del steps
            length = np.bincount(row, minlength=hi - lo)
            m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // max(1, n_terms)
            terms, number = np.unique(term, return_inverse=True)
            posting, tf = np.unique(number << 32 | place[row], return_counts=True)
            number, at = posting >> 32, posting & 0xFFFFFFFF
            impact = SCALE * tf // (TF_PART * tf + LENGTH_PART * m[np.argsort(place)][at])
            slices = np.stack([_packed((impact >> b & 1).astype(np.uint8)) for b in range(IMPACT_BITS)])
            starts = np.searchsorted(number, np.arange(len(terms) + 1))
            columns = np.sort(doc_ids), terms, starts.astype(np.int32), at.astype(np.int32), slices
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(map_arrow(rows, run, INDEX_SCHEMA), "impacts"), n_docs


def add(sums: np.ndarray, addend: np.ndarray, shift: int = 0) -> None:
    """Add ``addend`` (bits on the first axis, lowest first) times 2 ** shift to ``sums`` in place, by carries."""
    carry = np.zeros(sums.shape[1:], np.uint64)
    for b in range(shift, len(sums)):
        s = sums[b]
        if b - shift < len(addend):
            a = addend[b - shift]
            half = s ^ a
            carry, sums[b] = (s & a) | (half & carry), half ^ carry
        elif carry.any():
            carry, sums[b] = s & carry, s ^ carry
        else:
            return


def best(sums: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best of ``n`` documents by sums of bits x queries x words; of equal ones the first."""
    surely, open_ = np.zeros(sums.shape[1:], np.uint64), np.bitwise_or.reduce(sums, axis=0)
    for slice_ in sums[::-1]:
        with_bit = open_ & slice_
        more = np.bitwise_count(surely | with_bit).sum(axis=1, keepdims=True) > k
        #: Too many have the bit: only these stay open. Otherwise all with the bit are taken, and the others stay open.
        surely = np.where(more, surely, surely | with_bit)
        open_ = np.where(more, with_bit, open_ & ~slice_)
    taken = _unpacked(surely, n).astype(bool)
    equal = _unpacked(open_, n).astype(bool)
    taken |= equal & (np.cumsum(equal, axis=1) <= k - taken.sum(axis=1, keepdims=True))
    query, doc = np.nonzero(taken)
    score = np.zeros(len(query), np.int64)
    for b, slice_ in enumerate(sums):
        score |= (slice_[query, doc >> 6] >> (doc & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
    return query, doc, score


class _Block:
    """One row of the index."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.terms, self.starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int32).astype(np.int64)
        self.ids = np.frombuffer(row["ids"], np.int32)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(IMPACT_BITS, -1)

    def weighted(self, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the terms at ``at``: bits x postings of impact times weight, the postings' documents, each term's first one."""
        size = self.starts[at + 1] - self.starts[at]
        first = np.r_[0, np.cumsum(size)]
        posting = np.repeat(self.starts[at] - first[:-1], size) + np.arange(first[-1])
        chosen = np.stack([_packed(_unpacked(s, len(self.ids))[posting]) for s in self.slices])
        weight = np.repeat(weights, size)
        product = np.zeros((IMPACT_BITS + int(weights.max()).bit_length(), chosen.shape[1]), np.uint64)
        for b in range(int(weights.max()).bit_length()):
            add(product, chosen & _packed((weight >> b & 1).astype(np.uint8)), b)
        return _unpacked(product, int(first[-1])), self.ids[posting], first

    def ranked(self, query: _Query, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, score, doc_id) of the best k documents of each query."""
        at = np.searchsorted(self.terms, query.terms)
        known = np.flatnonzero((np.take(self.terms, at, mode="clip") == query.terms) & (at < len(self.terms)) & (query.weights > 0)) if len(self.terms) else np.zeros(0, np.int64)
        if not len(known):
            return
        bits, ids, first = self.weighted(at[known], query.weights[known])
        n = len(self.doc_ids)
        n_words = -(-n // 64)
        together = max(1, SUM_BYTES // (8 * n_words * query.bits))
        for low in range(0, query.n, together):
            high = min(query.n, low + together)
            sums = np.zeros((query.bits, high - low, n_words), np.uint64)
            for j, t in enumerate(known):
                of = slice(query.first[t], query.first[t + 1])
                inside = (query.queries[of] >= low) & (query.queries[of] < high)
                if not inside.any():
                    continue
                queries, times = query.queries[of][inside] - low, query.times[of][inside]
                docs = ids[first[j] : first[j + 1]]
                #: Only the words that hold a posting are touched.
                touched, word = np.unique(docs >> 6, return_inverse=True)
                dense = np.zeros((len(bits), 64 * len(touched)), np.uint8)
                dense[:, word * 64 + (docs & 63)] = bits[:, first[j] : first[j + 1]]
                addend = _packed(dense)[:, None, :]
                for b in range(int(times.max()).bit_length()):
                    some = queries[times >> b & 1 == 1]
                    if len(some):
                        region = sums[:, some[:, None], touched]
                        add(region, addend, b)
                        sums[:, some[:, None], touched] = region
            found, doc, score = best(sums, n, k)
            yield found + low, score, self.doc_ids[doc]


class _Query:
    """A block of queries: distinct terms with weights, and the queries that hold each, with how often."""

    def __init__(self, texts: list[str]) -> None:
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) for t in texts])
        term, _, row = words(data, np.r_[0, ends])
        self.n = len(texts)
        self.terms, number = np.unique(term, return_inverse=True)
        pair, self.times = np.unique(number * self.n + row, return_counts=True)
        self.queries = pair % self.n
        self.first = np.searchsorted(pair // self.n, np.arange(len(self.terms) + 1))
        self.weights, self.bits = np.zeros(len(self.terms), np.int64), 1

    def weigh(self, n_docs: int, frequency: dict[int, int]) -> None:
        df = [frequency.get(t, 0) for t in range(len(self.terms))]
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
        #: No score is above the sum of its weights times the largest impact.
        most = np.bincount(self.queries, np.repeat(self.weights, np.diff(self.first)).astype(float) * self.times, minlength=self.n).max(initial=0)
        self.bits = max(1, int(most * SCALE / TF_PART).bit_length() + 1)


def _frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """By the number of a term: how many documents hold it. At most one entry for each of ``terms``."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for raw, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            here, size = np.frombuffer(raw, np.uint64), np.diff(np.frombuffer(starts, np.int32))
            _, a, b = np.intersect1d(shared.value, here, assume_unique=True, return_indices=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(size[b], pa.int64())], names=["term", "n"])

    counted = map_arrow(index.select("terms", "starts"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {r.term: r.n for r in counted}


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = TOP, text: str = "text", item_id: str = "item_id", block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """The k best documents of each item (distinct rows of item_id and text): item_id, rank, doc_id, score."""
    spark = index.sparkSession
    asked = written(items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct(), "items")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = max(1, math.ceil(total / block_bytes)), []
    for number in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).filter("text IS NOT NULL").orderBy("item_id", "text").collect()
        query = _Query([r.text for r in part])
        if not len(query.terms):
            continue
        query.weigh(n_docs, _frequencies(index, query.terms))
        shared = spark.sparkContext.broadcast(query)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for row in batch.to_pylist():
                for which, score, doc_id in _Block(row).ranked(shared.value, k):
                    doc_id = pa.array(doc_id, pa.int64(), mask=doc_id == NO_ID)
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(score, pa.int64()), doc_id], names=["query", "score", "doc_id"])

        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        top = map_arrow(index, run, FOUND_SCHEMA).withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"query bigint, item_id {asked.schema['item_id'].dataType.simpleString()}")
        #: The names of one block of items, at most block_bytes of their texts' size.
        found.append(written(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)


SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM t WHERE len(w) > 0),
p AS (SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, term, count(*) AS times, any_value(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT) AS weight FROM q JOIN f USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score FROM x JOIN p USING (term), s GROUP BY 1, 2, 3),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
