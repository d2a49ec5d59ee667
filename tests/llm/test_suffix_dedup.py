"""Repeated byte strings against every string of every text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import SparkSession

from windrose.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, kept string"


def brute(texts: list[bytes], length: int = suffix_dedup.LENGTH) -> list[tuple[int, int, int, str]]:
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def results(spark: SparkSession, rows: list[tuple]) -> list[tuple]:
    found = suffix_dedup.repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found)


def test_cover_meets_every_distance() -> None:
    differences = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert len(differences) == suffix_dedup.PERIOD
    assert suffix_dedup.TUPLE + 2 * suffix_dedup.PERIOD >= suffix_dedup.LENGTH + suffix_dedup.PERIOD - 1


def test_against_every_string(spark: SparkSession) -> None:
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    shared = [prose(n) for n in (399, 400, 401, 430, 583, 700, 1500)]
    texts = [prose(rng.randint(0, 900)) for _ in range(20)]
    for piece in shared:
        for _ in range(rng.randint(2, 4)):
            cut = rng.randint(0, max(0, len(piece) - 395))
            texts.append(prose(rng.randint(0, 500)) + piece[cut:] + prose(rng.randint(0, 500)))
    whole = prose(2500)
    texts += [whole, whole, whole[:1200] + "X" + whole[1200:], whole[300:], "a" * 1000, "ab" * 450, "z" * 399, "z" * 400, "y" * 401, "", prose(700) + shared[4] + shared[5] + prose(30) + shared[5]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    expected = [(i, *x) for i, x in enumerate(brute([t.encode() for t in texts]))]
    assert results(spark, rows) == sorted(expected)


def test_nulls_repeated_rows_and_empty_tables(spark: SparkSession) -> None:
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(300))
    found = suffix_dedup.repeats(spark.createDataFrame([(1, text, None), (1, text, None), (None, "short", None), (2, None, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, len(r.kept)) for r in found) == [(0, 5, 0, 0, 5), (1, 600, 600, 1, 0), (1, 600, 600, 1, 0), (2, 0, 0, 0, 0)]
    assert suffix_dedup.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
