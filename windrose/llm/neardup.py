"""Near-duplicate classes by ProbMinHash.

A text's five-word shingles, weighted by how often they occur in it, are the elements of a Poisson process each: arrivals
at the rate of the weight, each at a random component of the signature. A component keeps the element that arrived
first; an element is dropped as soon as its next arrival comes after every component's first one. Two texts agree in a
component with the probability Jaccard of their weighted shingles. Components in bands name buckets; a bucket's smallest
node is its pivot, and the others are verified against it on whole shingle sets. Where a bucket still holds more than
one class afterwards, its members meet in blocks: one product of matrices bounds the similarity of all of a block's pairs,
those of different classes that reach the threshold are verified, and each link found joins two classes at once. So a
block passes on fewer links than it has members, and no pairs. Blocks are compared within themselves first, then two by
two where a bucket still has several. Verified links are merged by smallest label.

Words are runs of digits, letters and bytes beyond ASCII, lower-cased (A-Z); texts of fewer than five words are one
shingle. Nodes are distinct word sequences, so copies meet in one row at once whatever their number. Texts without words
only equal the same text; a null text equals nothing. ``class_id`` is the smallest doc_id of a class, null if none has
one. Texts of any length are compared whole. Repeated rows are in one class, rows that share a doc_id but not the text are classed each by its text. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import byte_spans, map_arrow, mix, prefix_sums, span_hash, text_chunks, words, written

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8, a pair shares a bucket with probability 0.9993.
BANDS, BAND_ROWS = 24, 6
#: Members of a pivot that are verified in one place, and places that learn how many a large pivot has.
SALTED_MEMBERS, SUBS = 250, 16
#: Members of a bucket, and bytes of their packed shingles, that make a block; any two blocks of a bucket meet.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Shingles that one product of matrices takes; by how much its 32-bit sums may be off.
COLUMNS, SLACK = 1 << 13, 1e-4

_STEP = np.uint64(0x632BE59BD9B4E019)
_ROW_BITS = np.uint64(48)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, count) in order of row and shingle, and the two 64-bit halves of each row's node."""
    n = len(offsets) - 1
    term, _, row = words(data, offsets)
    start = np.r_[0, np.cumsum(np.bincount(row, minlength=n))]
    spans = prefix_sums(term)
    at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :]) if len(row) >= width else np.zeros(0, np.int64)
    few = np.flatnonzero((np.diff(start) > 0) & (np.diff(start) < width))
    found = np.concatenate([span_hash(spans, at, at + width), span_hash(spans, start[few], start[few + 1])])
    key = np.sort(np.concatenate([row[at], few]).astype(np.uint64) << _ROW_BITS | found >> (np.uint64(64) - _ROW_BITS))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(key)])
    key = key[first]
    wordless = np.diff(start) == 0
    #: The halves of a node are hashes at unlike points; of texts without words those of their bytes.
    bare = np.flatnonzero(wordless)
    size = np.diff(offsets)[bare]
    edge = np.r_[0, np.cumsum(size)]
    raw = data[np.repeat(offsets[bare] - edge[:-1], size) + np.arange(edge[-1])]
    halves = []
    for point in (0, 1):
        half = span_hash(prefix_sums(term, point), start[:-1], start[1:], point)
        half[bare] = byte_spans(raw, edge[:-1], edge[1:], point)
        halves.append(half)
    return (key >> _ROW_BITS).astype(np.int64), key & ((np.uint64(1) << _ROW_BITS) - np.uint64(1)), counts, np.stack(halves, axis=1)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """The first element to arrive at each of ``size`` components, by row."""
    earliest = np.full(n_rows * size, np.inf)
    holder = np.zeros(n_rows * size, np.uint64)
    time, step = np.zeros(len(row)), 0
    while len(row):
        step = step + int(_STEP) & (1 << 64) - 1
        draw = mix(element + np.uint64(step))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        at = row * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        holder[at[won]] = element[won]
        alive = time < earliest.reshape(n_rows, size).max(axis=1)[row]
        row, element, weight, time = row[alive], element[alive], weight[alive], time[alive]
    return holder.reshape(n_rows, size)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets, given sorted."""
    everything = np.union1d(a, b)
    x, y = np.zeros(len(everything)), np.zeros(len(everything))
    x[np.searchsorted(everything, a)] = wa
    y[np.searchsorted(everything, b)] = wb
    both = (x > 0) & (y > 0)
    pairs, times = np.unique(np.stack([x[both], y[both]]), axis=1, return_counts=True)
    return float(sum(t / np.maximum(x / p, y / q).sum() for (p, q), t in zip(pairs.T, times, strict=True)))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, node and buckets of every row; written."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in text_chunks(batch, "text"):
            row, element, count, halves = shingles(data, offsets)
            holder = signatures(row, element, count.astype(float), hi - lo, BANDS * BAND_ROWS).reshape(hi - lo, BANDS, BAND_ROWS)
            bucket = np.zeros((hi - lo, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(BAND_ROWS):
                bucket = mix(bucket ^ holder[:, :, k])
            has = np.bincount(row, minlength=hi - lo) > 0
            nodes = halves.astype(">u8").tobytes()
            null = batch.column("text")[lo:hi].is_null().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("text_key")[lo:hi], pa.array([None if z else nodes[16 * i : 16 * i + 16] for i, z in enumerate(null)], pa.binary()), pa.array([b if h else [] for b, h in zip(bucket.view(np.int64).tolist(), has, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "buckets"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return written(map_arrow(rows, run, "doc_id bigint, text_key bigint, node binary, buckets array<bigint>"), "signed")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted node: its shingles and their counts, byte plane by byte plane; written."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in text_chunks(batch, "text"):
            row, element, count, halves = shingles(data, offsets)
            nodes, edge = halves.astype(">u8").tobytes(), np.searchsorted(row, np.arange(hi - lo + 1))
            spans = [(i, a, b) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if b > a]
            planes = lambda x, size: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[16 * i : 16 * i + 16] for i, _, _ in spans], pa.binary()), pa.array([planes(element[a:b], 6) + planes(count[a:b].astype(np.int64), 4) for _, a, b in spans], pa.binary())], names=["node", "shingles"])

    rows = docs.filter("text IS NOT NULL").select(F.col("text").cast("string").alias("text"))
    sets = map_arrow(rows, run, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return written(sets.join(wanted, "node", "left_semi"), "sets")


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(10, -1)
    wide = np.zeros((2, planes.shape[1], 8), np.uint8)
    wide[0, :, :6], wide[1, :, :4] = planes[:6].T, planes[6:].T
    return wide[0].view(np.uint64).ravel(), wide[1].view(np.int64).ravel().astype(float)


def salted(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a salt that splits the members of a pivot; written."""
    pairs = written(pairs, "pairs")
    sizes = pairs.groupBy("pivot").agg((F.count("*") / SALTED_MEMBERS).cast("bigint").alias("n")).filter("n > 0")
    #: The counts of large pivots, which are few, go to several places each, so that their members need not meet for them.
    sizes = sizes.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(SUBS - 1))))
    own = F.pmod(F.xxhash64("node", "pivot"), F.coalesce("n", F.lit(0)) + 1)
    return pairs.withColumn("sub", F.pmod(F.xxhash64("node"), F.lit(SUBS)).cast("int")).join(sizes, ["pivot", "sub"], "left").select("pivot", "node", own.alias("salt"))


def verified(pairs: DataFrame, sets: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The salted pairs (pivot, node, salt) whose similarity is large enough; written.

    The pivot is sent once to each of its salts.
    """
    wanted = pairs.select(F.col("node").alias("key"), "pivot", "salt", F.lit(1).alias("turn")).unionByName(pairs.select("pivot", "salt").distinct().select(F.col("pivot").alias("key"), "pivot", "salt", F.lit(0).alias("turn")))
    rows = wanted.join(sets.select(F.col("node").alias("key"), "shingles"), "key").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivot = None, None
        for batch in batches:
            found: list[tuple[bytes, bytes, int]] = []
            for key, of, salt, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "pivot", "salt", "turn", "shingles")), strict=True):
                if turn == 0:
                    held, pivot = _unpacked(raw), of
                elif pivot == of and similarity(*held, *_unpacked(raw)) >= at_least - 1e-12:
                    found.append((of, key, salt))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["pivot", "node", "salt"])

    return written(rows.mapInArrow(run, "pivot binary, node binary, salt bigint"), "links")


def merged(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node is connected to; written.

    A pivot's label goes once to each of its salts and from there to its members, so no task gets all of a hot pivot's links.
    """
    hubs = written(links.select("pivot", "salt").distinct(), "hubs")
    labels = written(links.select("node").union(hubs.select("pivot")).distinct().select("node", F.col("node").alias("label")), "labels")
    state = None
    while True:
        named = labels.select(F.col("node").alias("key"), F.col("label").alias("next"))
        down = links.join(hubs.join(named, F.col("pivot") == F.col("key")).select("pivot", "salt", "next"), ["pivot", "salt"]).select("node", F.col("next").alias("label"))
        up = links.join(named, F.col("node") == F.col("key")).groupBy("pivot").agg(F.min("next").alias("label"))
        labels = written(down.union(up).union(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        before, state = state, labels.agg(F.bit_xor(F.xxhash64("node", "label"))).first()[0]
        if before == state:
            return labels
        #: A label's own label is as good: paths halve with every round.
        own = labels.select(F.col("label").alias("key")).distinct().join(labels.select(F.col("node").alias("key"), F.col("label").alias("next")), "key").filter("key <> next")
        labels = written(labels.join(own, F.col("label") == F.col("key"), "left").select("node", F.coalesce("next", "label").alias("label")), "labels")


def block_links(sets: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, side: np.ndarray, at_least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of members that join their classes: members of different labels and sides whose similarity is large enough,
    and of these as many as it takes to connect what they connect.

    With p and q the shares of a's and b's weight that lie on common shingles, the probability Jaccard is at most
    pq / (q + (1 - q) p); it is equal to that where a and b have even weights.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    weight = np.concatenate([w / w.sum() for _, w in sets])
    _, column, times = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True, return_counts=True)
    #: What one member alone has is common to none.
    common = np.flatnonzero(times[column] > 1)
    order = common[np.argsort(column[common], kind="stable")]
    place = np.r_[0, np.cumsum(np.diff(column[order]) != 0)] if len(order) else np.zeros(0, np.int64)
    p = np.zeros((n, n), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        shares, holds = np.zeros((n, COLUMNS), np.float32), np.zeros((n, COLUMNS), np.float32)
        shares[row[order[a:b]], place[a:b] - low] = weight[order[a:b]]
        holds[row[order[a:b]], place[a:b] - low] = 1
        p += shares @ holds.T
    q = p.T
    most = p * q / np.maximum(q + (1 - q) * p, 1e-9)
    most = np.minimum(most, most.T)
    even = np.array([w.min() == w.max() for _, w in sets])
    one, two = np.nonzero(np.triu(most >= at_least - SLACK, 1) & (label[:, None] != label) & ((side[:, None] != side) | (side[:, None] < 0)))
    root = list(range(int(label.max()) + 1))
    found = []
    for k in np.argsort(-most[one, two], kind="stable").tolist():
        i, j = int(one[k]), int(two[k])
        x, y = int(label[i]), int(label[j])
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y and (even[i] and even[j] and most[i, j] >= at_least + SLACK or similarity(*sets[i], *sets[j]) >= at_least - 1e-12):
            root[max(x, y)] = min(x, y)
            found.append((i, j))
    return found


def mixed_buckets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, and how many members make a block there, of the buckets with members of different labels; written.

    Buckets with the same members are compared once. Two members have met as pivot and node.
    """
    each = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.expr(f"n * {BLOCK_BYTES} div bytes"))).alias("each")
    hashed = F.xxhash64("node")
    counted = members.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node").groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftrightunsigned(hashed, 32)).alias("s"), F.min("label").alias("low"), F.max("label").alias("high"))
    return written(counted.filter("n > 2 AND low <> high").groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket"), F.first("bytes").alias("bytes")).select("bucket", "n", each), "mixed")


def within_blocks(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every member of the buckets once, in a block (bucket, i, j) of its own side."""
    return members.join(buckets, "bucket").select("node", "label", "bucket", F.pmod(F.xxhash64("node"), F.expr("(n - 1) div each") + 1).alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(-1).cast("bigint").alias("own"))


def across_blocks(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """The members of the buckets in pairs of blocks (bucket, i, j), two sides each.

    A bucket's most common label need not meet itself; blocks of the other members meet its blocks, one another and
    themselves (without sides). So where few members are left out of a large class, that class is sent once.
    """
    rows = members.join(buckets.filter("n > each"), "bucket")
    labels = rows.groupBy("bucket", "label").agg(F.count("*").alias("own_n"))
    top = labels.groupBy("bucket").agg(F.max_by("label", F.struct("own_n", "label")).alias("top"), F.max("own_n").alias("top_n"))
    rows = rows.join(top, "bucket").withColumn("in_top", F.col("label") == F.col("top")).withColumn("rest", F.expr("(n - top_n - 1) div each")).withColumn("last", F.expr("(top_n - 1) div each"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("in_top"), F.col("last")).otherwise(F.col("rest")) + 1)
    #: Blocks of the most common label have the numbers from ``rest`` + 1 on.
    rows = rows.withColumn("own", F.when(F.col("in_top"), F.col("rest") + 1 + own).otherwise(own))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("in_top"), F.col("rest")).otherwise(F.col("rest") + 1 + F.col("last")))
    rows = rows.withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    return rows.select("node", "label", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("own"))


def joined_classes(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, node, salt): links between labels, from members that lie in one block but not on one side of it (-1: none); written."""
    rows = dealt.join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def done() -> pa.RecordBatch:
            names = sorted({g[5] for g in group})
            number = {x: k for k, x in enumerate(names)}
            found = []
            if len(names) > 1:
                label, side = np.array([number[g[5]] for g in group]), np.array([g[3] for g in group])
                found = [sorted((group[a][5], group[b][5])) for a, b in block_links([_unpacked(g[6]) for g in group], label, side)]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["pivot", "node"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "own", "node", "label", "shingles")), strict=True):
                if group and group[0][:3] != r[:3]:
                    yield done()
                    group.clear()
                group.append(r)
        yield done()

    return written(salted(rows.mapInArrow(run, "pivot binary, node binary").distinct()), "joins")


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` with their own labels in ``further``; labels of nodes that are alone there are nodes themselves."""
    final = labels.join(further.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return written(final.unionByName(further.join(labels.select("node"), "node", "left_anti")), "labels")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the label of its class (null for a null text); written."""
    rows = signed(docs)
    nodes = written(rows.filter("size(buckets) > 0").groupBy("node").agg(F.first("buckets").alias("buckets")), "nodes")
    buckets = nodes.select("node", F.explode("buckets").alias("bucket"))
    pivots = written(buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n"), "pivots")
    shared = written(buckets.join(pivots, "bucket"), "shared")
    sets = shingle_sets(docs, shared.select("node"))
    labels = merged(verified(salted(shared.filter("node <> pivot").select("pivot", "node").distinct()), sets))
    #: Within blocks first, where each member is once: what that connects need not be compared across blocks.
    for deal in (within_blocks, across_blocks):
        members = written(shared.drop("pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "members")
        links = joined_classes(deal(members, mixed_buckets(members, sets)), sets)
        if not links.isEmpty():
            labels = relabelled(labels, merged(links))
    return written(rows.select("doc_id", "text_key", "node").join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label")), "labelled")


def first_in_class() -> Column:
    """Orders the rows of a class: by doc_id, nulls last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))


def classes(docs: DataFrame) -> DataFrame:
    """Every document with its class and the number of documents in it."""
    rows = labelled(docs)
    #: Written, so that the rows of a large class can be split where they meet it.
    sizes = written(rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    named = rows.join(sizes, "label", "left")
    return named.select("doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with the columns that it came with.

    Null texts stay. Of rows that repeat doc_id (or its null) and text, one stays; rows that share a doc_id with unlike texts stay.
    """
    found = labelled(docs).filter("label IS NOT NULL").groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("n"))
    kept = found.groupBy("label").agg(F.min_by(F.struct(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("n").alias("_n")), first_in_class()).alias("first")).select("first.*")
    kept = written(kept, "kept")
    on = docs["doc_id"].cast("bigint").eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_key"])
    out = docs.filter(docs["text"].isNotNull())
    once = out.join(kept.filter(kept["_n"] == 1), on, "left_semi").unionByName(docs.filter(docs["text"].isNull()))
    again = kept.filter(kept["_n"] > 1)
    return once if again.isEmpty() else once.unionByName(out.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))


#: The same rows; on large tables it would take too much memory.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, dense_rank() OVER (ORDER BY CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 't' || text END) AS node FROM d),
s AS (SELECT node, any_value(w) AS w FROM n WHERE len(w) > 0 GROUP BY node),
g AS (SELECT node, x, count(*)::DOUBLE AS c FROM (SELECT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS x FROM s) GROUP BY 1, 2),
t AS (SELECT node, x, c, c / sum(c) OVER (PARTITION BY node) AS share FROM g),
p AS (SELECT a.node AS i, b.node AS j, sum(a.share) AS p, sum(b.share) AS q FROM t a JOIN t b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2),
z AS (SELECT i, j, x, sum(a) AS a, sum(b) AS b FROM (SELECT i, j, x, c AS a, 0 AS b FROM p JOIN t ON node = i WHERE p * q / (q + (1 - q) * p) >= 0.799999 UNION ALL SELECT i, j, x, 0, c FROM p JOIN t ON node = j WHERE p * q / (q + (1 - q) * p) >= 0.799999) GROUP BY 1, 2, 3),
e AS (SELECT i, j FROM (SELECT y.i, y.j, y.x, sum(greatest(z.a / y.a, z.b / y.b)) AS below FROM z y JOIN z ON y.i = z.i AND y.j = z.j WHERE y.a > 0 AND y.b > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(1 / below) >= 0.8 - 1e-12),
l AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
r AS (SELECT node, node AS other FROM (SELECT DISTINCT node FROM n) UNION SELECT r.node, l.j FROM r JOIN l ON r.other = l.i),
k AS (SELECT node, min(other) AS label FROM r GROUP BY 1),
c AS (SELECT label, min(doc_id) AS class_id, count(*) AS class_size FROM n JOIN k USING (node) GROUP BY 1)
SELECT doc_id, class_id, class_size FROM n JOIN k USING (node) JOIN c USING (label) UNION ALL SELECT doc_id, doc_id, 1 FROM documents WHERE text IS NULL
"""
