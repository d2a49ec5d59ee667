"""Spelling variants by two-dimensional range reporting with wavelet trees.

Words that lie one inserted, deleted or replaced code point apart share what stands before that place and what stands
after it. So words are sorted forwards and backwards: a prefix is an interval of the one order, a suffix an interval of the
other, and a word is a point, its rank in both. For each word and each edit position the points inside the rectangle of
the word's prefix and suffix are the near words; a wavelet tree over the backward ranks in forward order reports them.

The vocabulary is cut into groups that fit a task. A word of length L and a near one of length L or L + 1 that differ at a
place in [low, high) share the first ``low`` code points and the last L - high: a group is all words with these in common.
At first the places are cut in two halves. A group of more than ``GROUP_WORDS`` has its places cut in half again and again,
down to single places, where at most the alphabet is left. Every near pair differs at one place (of several equal
insertions the leftmost counts), so it is found in exactly one group, and tasks pass on counts and best words, no pairs.

A null text has no words, a null doc_id counts as an empty one, repeated rows count each. An empty table, or one without
words that occur often enough, gives no rows. Texts and words of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import written

MIN_CHARS, MIN_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
#: Words of a group that is not cut further; the share of all members that a group may hold in any case, which bounds the
#: list of larger groups; members and code points of a task; rectangles that are searched together.
GROUP_WORDS, GROUP_SHARE = 20_000, 20_000
TASK_MEMBERS, TASK_CHARS = 200_000, 4_000_000
RECTANGLES = 1 << 17

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR_SCHEMA = "word string, n_near bigint, best_n bigint, best string"


def damaged_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The words of all texts: runs of letters, A-Z lower-cased, one code point of each ``DAMAGE``-th by checksum deleted."""
    #: Shorter runs make no words, damaged or not.
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit("[A-Za-zÀ-ÿ]{%d,}" % MIN_CHARS), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h, length = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = F.pmod(h, length).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, length))
    return rows.select(F.when(h % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= MIN_CHARS)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words with their occurrences, written."""
    return written(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count), "vocabulary")


class WaveletTree:
    """A permutation of 0 .. n - 1, its bits level by level, highest first; zeros of each level go left, in order."""

    def __init__(self, values: np.ndarray) -> None:
        self.depth = max(1, int(max(1, len(values)) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.depth - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~ones)])
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of the points at places [a, b) whose values lie in [c, d)."""
        which, low = np.arange(len(a)), np.zeros(len(a), np.int64)
        for bit, zeros in zip(range(self.depth - 1, -1, -1), self.zeros, strict=True):
            za, zb, left = zeros[a], zeros[b], zeros[-1]
            half = low + (1 << bit)
            down = (za < zb) & (c[which] < half) & (d[which] > low)
            up = (a - za < b - zb) & (d[which] > half) & (c[which] < half + (1 << bit))
            a, b = np.concatenate([za[down], (left + a - za)[up]]), np.concatenate([zb[down], (left + b - zb)[up]])
            low, which = np.concatenate([low[down], half[up]]), np.concatenate([which[down], which[up]])
        return which, low


class _Order:
    """Sorted words as rows of code points, and the intervals of what they begin with."""

    def __init__(self, words: list[str], width: int) -> None:
        self.order = sorted(range(len(words)), key=words.__getitem__)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        points = np.frombuffer("".join(words[k].ljust(width, "\0") for k in self.order).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        #: How many code points each word shares with the one before it.
        self.shared = np.r_[-1, np.logical_and.accumulate(points[1:] == points[:-1], axis=1).sum(axis=1)] if len(words) else np.zeros(0, np.int64)

    def interval(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By rank: the ranks of the words with the same first ``n`` code points."""
        first = np.flatnonzero(self.shared < n)
        part = np.cumsum(self.shared < n) - 1
        return first[part], np.r_[first[1:], len(self.shared)][part]


def _pairs(words: list[str], length: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word of ``length``, near word) for edits at [low, high); replacements both ways, insertions from the shorter one."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer("".join(w.ljust(length + 1, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length + 1)
    forward, backward = _Order(words, length + 1), _Order([w[::-1] for w in words], length + 1)
    short = np.flatnonzero(sizes == length)
    if not len(short):
        return
    for inserted in (0, 1):
        chosen = sizes == length + inserted
        if chosen.sum() < 2 - inserted:
            continue
        #: How many of the chosen words come before each rank of both orders.
        before = [np.r_[0, np.cumsum(chosen[o.order])] for o in (forward, backward)]
        members = [np.array(o.order)[chosen[o.order]] for o in (forward, backward)]
        tree = WaveletTree(before[1][backward.rank[members[0]]])
        waiting: list[np.ndarray] = []
        for i in range(low, min(high, length + inserted)):
            a, b = (before[0][x[forward.rank[short]]] for x in forward.interval(i))
            c, d = (before[1][x[backward.rank[short]]] for x in backward.interval(length - i - 1 + inserted))
            #: A rectangle one place wide or high holds a replaced word itself at most.
            some = np.flatnonzero((b - a > 1 - inserted) & (d - c > 1 - inserted))
            waiting.append(np.stack([short[some], np.full(len(some), i), a[some], b[some], c[some], d[some]]))
        queries = np.concatenate(waiting, axis=1) if waiting else np.zeros((6, 0), np.int64)
        for k in range(0, queries.shape[1], RECTANGLES):
            word, i, a, b, c, d = queries[:, k : k + RECTANGLES]
            which, value = tree.report(a, b, c, d)
            word, i, found = word[which], i[which], members[1][value]
            if inserted:
                fresh = (i == 0) | (points[word, i - 1] != points[found, i])
            else:
                fresh = word != found
            yield word[fresh], found[fresh]


def _near(members: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each group of a task knows of its words: how many near ones, and the best of them."""
    parts: dict[tuple[int, int, int], dict[str, int]] = {}
    for batch in members:
        for word, n, length, low, high in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "length", "low", "high")), strict=True):
            parts.setdefault((length, low, high), {})[word] = n
    for (length, low, high), counts in parts.items():
        words = sorted(counts)
        n = np.array([counts[w] for w in words], np.int64)
        near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for left, right in _pairs(words, length, low, high):
            if len(left) and len(words[right[0]]) > length:
                left, right = np.concatenate([left, right]), np.concatenate([right, left])
            near += np.bincount(left, minlength=len(words))
            order = np.lexsort((right, -n[right], left))
            left, right = left[order], right[order]
            head = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
            left, right = left[head], right[head]
            old = best[left]
            better = (old < 0) | (n[right] > n[old]) | ((n[right] == n[old]) & (right < old))
            best[left[better]] = right[better]
        some = np.flatnonzero(near)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in some], pa.string()), pa.array(near[some]), pa.array(n[best[some]]), pa.array([words[k] for k in best[some]], pa.string())], names=["word", "n_near", "best_n", "best"])


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with a key of what their words share outside [low, high)."""
    tail = F.greatest(F.col("length") - F.col("high"), F.lit(0))
    before, after = F.substring(F.col("word"), F.lit(1), F.col("low")), F.substring(F.col("word"), F.char_length("word") - tail + 1, tail)
    return rows.withColumn("key", F.xxhash64("length", "low", "high", before, after))


def _halved(rows: DataFrame) -> DataFrame:
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return _grouped(rows.select("word", "n", "length", F.explode(halves).alias("half")).select("word", "n", "length", "half.low", "half.high"))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS, task_members: int = TASK_MEMBERS) -> DataFrame:
    """By word (distinct, with its ``n``): how many words are near, and the one of largest n, by code points on ties."""
    lengths = F.array(F.char_length("word"), F.char_length("word") - 1)
    whole = words.select("word", "n", F.explode(lengths).alias("length")).filter("length > 0")
    rows, done = _halved(whole.withColumn("low", F.lit(0)).withColumn("high", F.col("length") + 1)), []
    total = rows.agg(F.count("*").alias("n"), F.sum(F.char_length("word")).alias("chars")).first()
    limit = max(group_words, total.n // GROUP_SHARE)
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("members"), F.max(F.col("high") - F.col("low")).alias("places")).filter((F.col("members") > limit) & (F.col("places") > 1)).select("key")
        #: A group of more than the limit has at least a GROUP_SHARE-th of the first members; halving doubles them at most.
        keys = [r.key for r in large.collect()]
        if not keys:
            done.append(rows)
            break
        listed = F.broadcast(words.sparkSession.createDataFrame([(k,) for k in keys], "key bigint"))
        done.append(rows.join(listed, "key", "left_anti"))
        rows = _halved(rows.join(listed, "key", "left_semi"))
    members = reduce(DataFrame.unionByName, done)
    tasks = max(1, -(-total.n // task_members), -(-(total.chars or 0) // TASK_CHARS))
    found = members.select("word", "n", "length", "low", "high", "key").repartition(tasks, "key").mapInArrow(_near, NEAR_SCHEMA)
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.rank")).alias("near_n"), F.col("best.word").alias("near"))


def variants(words: DataFrame, ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """Each word with its form, the root that forms lead to, and its near words."""
    is_form: Column = F.col("near_n") >= ratio * F.col("n")
    near = near_words(words, group_words)
    rows = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    #: Forms are far more frequent than their words, so paths are short; each round doubles the steps of a link.
    links = written(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = written(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "links")
        links = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The checksum bit by bit, as DuckDB has none; pairs by what is left when one code point is taken out of a word.
SQL = r"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc, run, count(*) AS times, list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
c AS (SELECT run, times, xor(4294967295, list_reduce(b, lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))), 4294967295)) AS h FROM g),
d AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM c),
w AS (SELECT word, sum(times)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.rest
      UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.rest),
k AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rank FROM p),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0)::BIGINT AS n_near, CASE WHEN k.near_n >= 10 * w.n THEN k.near END AS form, CASE WHEN k.near_n >= 10 * w.n THEN k.near_n END AS form_n
      FROM w LEFT JOIN k ON w.word = k.word AND k.rank = 1),
t AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT t.word, f.form, steps + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
o AS (SELECT word, arg_max(root, steps) AS root FROM t GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
"""
