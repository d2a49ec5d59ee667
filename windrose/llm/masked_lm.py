"""Masked pseudo-likelihood of documents under a small bidirectional network.

Words are hashed into buckets; the buckets' counts over the whole corpus put the most frequent ones into classes of their
own and the others into classes of about equal weight. A window network, trained here, predicts the class of every word
from the classes of the ``WINDOW`` words on either side. Within its class a bucket is predicted from both sides too: its
share of the counts times how much more often than the class it stands beside the classes that are next to it on the left
and on the right, divided by the sum of that over the class. A document's score is the sum of these conditional
log-probabilities over all its words, and their mean.

Training runs data-parallel over all documents. Every word is masked in exactly one of the ``ROUNDS`` rounds, dealt by
its position and the words of its text. In each round a task starts from the common weights and takes minibatch steps over
the round's words of its documents; the weights are then averaged, weighted by positions, in one aggregation. Only counts
and weights, whose number is a parameter, reach the driver.

Words are runs of digits, letters and bytes beyond ASCII, lower-cased (A-Z). A null or wordless text has no words, a
sum of 0 and a mean of 0. Repeated rows get equal scores. Texts of any length are read whole, in steps of a batch of words. Without any word in the corpus the network stays as drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, mix, text_chunks, words, written

BUCKETS, CLASSES, OWN = 1 << 16, 64, 48
WINDOW, HIDDEN = 3, 24
ROUNDS, BATCH = 2, 4096
RATE, SEED = 0.01, 7
#: Words that one step of a pass takes at a time.
STEP = 1 << 19
#: Parts of the table of neighbours, tables added up in one place, and words that the class's neighbours count for.
PARTS, FAN, PRIOR = 64, 32, 20.0
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]


def _shapes() -> list[tuple[int, ...]]:
    return [(len(OFFSETS), CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]


class Network:
    """Embeddings by offset and class (the last class lies beyond the text), one hidden layer, a softmax over classes."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, self.parts, at = flat.astype(np.float32), [], 0
        for shape in _shapes():
            n = int(np.prod(shape))
            self.parts.append(self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def drawn(cls) -> Network:
        rng = np.random.default_rng(SEED)
        return cls(np.concatenate([rng.normal(0, 0.1 if len(s) > 1 else 0, s).ravel() for s in _shapes()]))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        embed, bias = self.parts[:2]
        total = np.repeat(bias[None], context.shape[1], axis=0)
        for p, ids in enumerate(context):
            total += embed[p][ids]
        return np.tanh(total)

    def log_probabilities(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.hidden(context)
        logits = h @ self.parts[2] + self.parts[3]
        logits -= logits.max(axis=1, keepdims=True)
        return h, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h, logp = self.log_probabilities(context)
        d = np.exp(logp)
        d[np.arange(len(target)), target] -= 1
        d /= len(target)
        dh = (d @ self.parts[2].T) * (1 - h * h)
        each = np.eye(CLASSES + 1, dtype=np.float32)
        return np.concatenate([*((each[ids].T @ dh).ravel() for ids in context), dh.sum(axis=0), (h.T @ d).ravel(), d.sum(axis=0)])


class Steps:
    """Adam on a network's weights."""

    def __init__(self, network: Network) -> None:
        self.network, self.n = network, 0
        self.mean, self.square = np.zeros_like(network.flat), np.zeros_like(network.flat)

    def take(self, context: np.ndarray, target: np.ndarray) -> None:
        g, self.n = self.network.gradient(context, target), self.n + 1
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.001 * (g * g - self.square)
        self.network.flat -= RATE * (self.mean / (1 - 0.9**self.n)) / (np.sqrt(self.square / (1 - 0.999**self.n)) + 1e-8)


class Vocabulary:
    """The class of each bucket and the log of its share there."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        self.class_of = np.empty(BUCKETS, np.uint8)
        self.class_of[order[:OWN]] = np.arange(OWN)
        rest = np.cumsum(counts[order[OWN:]] + 1e-9)
        self.class_of[order[OWN:]] = OWN + np.minimum(CLASSES - OWN - 1, ((rest - 1e-12) * (CLASSES - OWN) / rest[-1]).astype(np.int64))
        weight = counts + 0.5
        total = np.bincount(self.class_of, weight, CLASSES)
        self.log_share = np.log(weight / total[self.class_of])


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id and the buckets of the words of every document, two bytes each; written, so that the passes that follow do not
    look for words again."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in text_chunks(batch, "text"):
            term, _, row = words(data, offsets)
            raw, ends = (term % np.uint64(BUCKETS)).astype("<u2").tobytes(), 2 * np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "words"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(map_arrow(rows, run, "doc_id bigint, words binary"), "words")


def _bucketed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of each word, its row) of consecutive documents, texts or hashed; a longer one is a step by
    itself."""
    if "words" not in batch.schema.names:
        for lo, hi, data, offsets in text_chunks(batch, "text"):
            term, _, row = words(data, offsets)
            yield lo, hi, (term % np.uint64(BUCKETS)).astype(np.int64), row
        return
    col = batch.column("words")
    if not len(col):
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // 2
    data = np.frombuffer(buffers[2], "<u2") if buffers[2] is not None and buffers[2].size else np.zeros(0, "<u2")
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]].astype(np.int64), np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
        lo = hi


def contexts(classes: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes around the positions, by offset; CLASSES where the text has ended."""
    out = np.full((len(OFFSETS), len(at)), CLASSES, np.int64)
    for p, o in enumerate(OFFSETS):
        there = at + o
        inside = np.flatnonzero((there >= 0) & (there < len(row)))
        inside = inside[row[there[inside]] == row[at[inside]]]
        out[p, inside] = classes[there[inside]]
    return out


def masked_in(bucket: np.ndarray, row: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each word is masked."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[first, len(row)])
    text = mix(np.add.reduceat(bucket, first).astype(np.uint64)) if len(row) else np.zeros(0, np.uint64)
    place = (np.arange(len(row)) - np.repeat(first, lengths)).astype(np.uint64)
    return (mix(np.repeat(text, lengths) + place) % np.uint64(rounds)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket, _ in _bucketed(batch):
                counts += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def beside(classes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The class on the left and on the right of every word; CLASSES where the text has ended."""
    out = np.full((2, len(row)), CLASSES, np.int64)
    inside = np.flatnonzero(row[1:] == row[:-1])
    out[0, inside + 1], out[1, inside] = classes[inside], classes[inside + 1]
    return out


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _added(table: pa.Table) -> pa.Table:
    """One row with the sum of the counts of a part."""
    total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "task": table.column("task").slice(0, 1), "counts": pa.array([_packed(total)], pa.binary())})


def neighbour_counts(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """[side, bucket, class]: how often each class stands on the left (0) and right (1) of a bucket."""
    known, schema = texts.sparkSession.sparkContext.broadcast(vocabulary), "part int, task bigint, counts binary"
    size = BUCKETS * (CLASSES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            for _, _, bucket, row in _bucketed(batch):
                for side, classes in enumerate(beside(known.value.class_of[bucket].astype(np.int64), row)):
                    cells, times = np.unique(bucket * (CLASSES + 1) + classes, return_counts=True)
                    counts[side, cells] += times
        parts, task = counts.reshape(2, PARTS, -1), TaskContext.get().partitionId()
        full = [k for k in range(PARTS) if parts[:, k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([task] * len(full), pa.int64()), pa.array([_packed(np.ascontiguousarray(parts[:, k])) for k in full], pa.binary())], names=["part", "task", "counts"])

    tables = written(texts.mapInArrow(run, schema), "neighbours")
    n = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while n > 1:
        tables, n = written(tables.withColumn("task", F.expr(f"task div {FAN}")).groupBy("part", "task").applyInArrow(_added, schema), "neighbours"), -(-n // FAN)
    out = np.zeros((2, PARTS, size // PARTS), np.int64)
    for r in tables.collect():
        out[:, r.part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), np.int64).reshape(2, -1)
    return out.reshape(2, BUCKETS, CLASSES + 1)


class Neighbours:
    """Logs of how much likelier a bucket than its class stands beside each class, and of their sums over a class."""

    def __init__(self, counts: np.ndarray, vocabulary: Vocabulary) -> None:
        of, share = vocabulary.class_of, np.exp(vocabulary.log_share)
        self.log_ratio = np.zeros(counts.shape, np.float16)
        self.log_sum = np.zeros((CLASSES, CLASSES + 1, CLASSES + 1), np.float32)
        for c in range(CLASSES):
            members = np.flatnonzero(of == c)
            own = counts[:, members].astype(float)
            whole = own.sum(axis=1) + 0.5
            usual = (whole / whole.sum(axis=1, keepdims=True))[:, None]
            ratio = (own / usual + PRIOR) / (own.sum(axis=2, keepdims=True) + PRIOR)
            self.log_ratio[:, members] = np.log(ratio)
            left, right = np.exp(self.log_ratio[:, members].astype(float))
            self.log_sum[c] = np.log((left * share[members, None]).T @ right)

    def of(self, bucket: np.ndarray, classes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.log_ratio[0, bucket, left].astype(np.float32) + self.log_ratio[1, bucket, right] - self.log_sum[classes, left, right]


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    context = texts.sparkSession.sparkContext
    known, flat = context.broadcast(vocabulary), Network.drawn().flat
    for number in range(rounds):
        start = context.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            steps, seen = Steps(Network(start.value.copy())), 0
            for batch in batches:
                for _, _, bucket, row in _bucketed(batch):
                    classes = known.value.class_of[bucket]
                    masked = np.flatnonzero(masked_in(bucket, row, rounds) == number)
                    for k in range(0, len(masked), BATCH):
                        at = masked[k : k + BATCH]
                        steps.take(contexts(classes, row, at), classes[at])
                        seen += len(at)
            total = steps.network.flat.astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, float(seen)))], names=["place", "value"])

        sums = np.zeros(len(flat) + 1)
        for r in texts.mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            sums[r.place] = r.value
        if sums[-1]:
            #: Rounded, as sums differ in their last digits with the order of partial sums.
            flat = np.round(sums[:-1] / sums[-1], 5).astype(np.float32)
    return Network(flat)


def score(texts: DataFrame, vocabulary: Vocabulary, neighbours: Neighbours, network: Network) -> DataFrame:
    known = texts.sparkSession.sparkContext.broadcast((vocabulary, neighbours, network.flat))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary, neighbours, flat = known.value
        network = Network(flat)
        for lo, hi, bucket, row in _bucketed(batch):
            classes, total = vocabulary.class_of[bucket], np.zeros(hi - lo)
            left, right = beside(classes, row)
            for k in range(0, len(row), BATCH):
                at = np.arange(k, min(k + BATCH, len(row)))
                logp = network.log_probabilities(contexts(classes, row, at))[1][np.arange(len(at)), classes[at]]
                inner = vocabulary.log_share[bucket[at]] + neighbours.of(bucket[at], classes[at], left[at], right[at])
                total += np.bincount(row[at], logp + inner, hi - lo)
            n = np.bincount(row, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(n.astype(np.int64)), pa.array(total), pa.array(total / np.maximum(1, n))], names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return map_arrow(texts, run, "doc_id bigint, n_words bigint, log_likelihood double, mean_log_likelihood double")


def likelihoods(docs: DataFrame) -> DataFrame:
    """doc_id, words, and the sum and mean of their conditional log-probabilities."""
    texts = hashed(docs)
    only = texts.select("words")
    vocabulary = Vocabulary(bucket_counts(only))
    neighbours = Neighbours(neighbour_counts(only, vocabulary), vocabulary)
    return score(texts, vocabulary, neighbours, train(only, vocabulary))
