"""Spelling variants, token counts and ranked search against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from windrose.llm import ranked_search, spelling, token_counts

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows: list) -> Counter:
    found: Counter = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 7 and n >= 2})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts: Counter) -> list[tuple]:
    form, near = {}, {}
    for w, n in counts.items():
        close = sorted((x for x in counts if one_edit(w, x)), key=lambda x: (-counts[x], x))
        near[w], form[w] = len(close), close[0] if close and counts[close[0]] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def noisy(seed: int, n: int) -> str:
    rng = random.Random(seed)
    base = ["abababab", "aaaaaaaa", "Éclairage", "éclairage", "straßen×weg", "information", "INFORMATION", "ÿÿÿÿÿÿÿ"]
    out = []
    for _ in range(n):
        w = rng.choice(base[: 1 + rng.randrange(len(base))])
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i + 1 :]])
        out.append(w)
    return " ".join(out)


@pytest.mark.parametrize("group_words", [2, 20_000])
def test_variants_equal_all_pairs(spark: SparkSession, odd: DataFrame, group_words: int) -> None:
    texts = [noisy(s, 400) for s in range(6)] + ["q" * 3000 + " " + "q" * 2999 + "x"] * 2 + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    counts = plain_words(docs.collect())
    words = spelling.vocabulary(spelling.damaged_words(docs))
    assert {r.word: r.n for r in words.collect()} == counts
    got = sorted((tuple(r) for r in spelling.variants(words, group_words=group_words).collect()), key=str)
    assert got == plain_variants(counts)
    assert sum(1 for r in got if r[1]) > 20


def test_variants_of_nothing(empty: DataFrame) -> None:
    out = spelling.variants(spelling.vocabulary(spelling.damaged_words(empty)))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_wavelet_tree_reports_rectangles() -> None:
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        a, c = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        b, d = np.minimum(n, a + rng.integers(0, n + 1, 200)), np.minimum(n, c + rng.integers(0, n + 1, 200))
        got = sorted(zip(*(x.tolist() for x in spelling.WaveletTree(values).report(a, b, c, d)), strict=True))
        assert got == sorted((q, int(v)) for q in range(200) for v in values[a[q] : b[q]] if c[q] <= v < d[q])


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_equal_the_library(spark: SparkSession, odd: DataFrame, tmp_path) -> None:  # noqa: ANN001
    texts = ["a\tb\n\n c ", "A  <|endoftext|> x", "<|ENDOFTEXT|>", "é ́\ń", "don't\x0bstop", "1234 %%%", noisy(1, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    model = Tokenizer.from_file(PATH)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    path = f"{tmp_path}/cache"
    got = token_counts.count_tokens(docs, PATH, path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_of_odd_strings(name: str) -> None:
    path, rng = public_tokenizers.path(name), random.Random(3)
    model = Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|", "|>", "'s", "don't", "9", "½", "é", "e\u0301", "\u00a0", "\u2003", "\x85", "\x0b", " ", "\n", "\t", "\x00", "\x01", "漢字", "👩‍👩‍👧", "İ", "ß", "word", "-", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    assert token_counts._counter(path)(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_only_distinct_misses_are_encoded(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "one  two", "one two"] * 500 + ["three"])], "doc_id bigint, text string")
    path = f"{tmp_path}/cache"
    cache = token_counts.TokenCache(docs, path, PATH)
    assert cache.misses().count() == 2
    cache.fill()
    assert cache.misses().count() == 0 and spark.read.parquet(path).count() == 2
    grown = token_counts.TokenCache(docs.unionByName(docs.limit(1).selectExpr("doc_id", "'four' AS text")), path, PATH)
    assert [r.text for r in grown.misses().collect()] == ["four"]
    out = token_counts.count_tokens(grown.docs, PATH, path)
    assert out.count() == 1502 and spark.read.parquet(path).count() == 3
    # What is stored is what is read, and another tokenizer does not read it.
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.TokenCache(docs, path, other).misses().count() == 3
    model = SentencePieceProcessor(model_file=other)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(docs, other, path).collect()) == sorted(len(model.encode(r.text)) for r in docs.collect())


def test_token_counts_of_nothing(empty: DataFrame, tmp_path) -> None:  # noqa: ANN001
    assert token_counts.count_tokens(empty, PATH, f"{tmp_path}/cache").count() == 0


def plain_ranking(docs: list, items: list, k: int = 10) -> list[tuple]:
    def terms(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    held = [(r.doc_id, Counter(terms(r.text))) for r in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in {(r.item_id, r.text) for r in items}:
        scores = []
        for doc_id, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
            scores.append((-score, -(10**9) if doc_id is None else doc_id))
        out += [(item_id, rank, None if doc_id == -(10**9) else doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1) if score < 0]
    return sorted(out, key=str)


def test_ranking_equals_plain_scores(spark: SparkSession, odd: DataFrame) -> None:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "ÉLAN", "9", "x-y", "é"]
    texts = [" ".join(rng.choice(vocabulary[: rng.randrange(1, len(vocabulary))]) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    docs = spark.createDataFrame([(rng.randrange(1000), t) for t in texts + texts[:40]], "doc_id bigint, text string").unionByName(odd.select("doc_id", "text")).repartition(4)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    items = spark.createDataFrame([*items, items[3], (None, "w1 w1 w1 w2"), (77, None), (78, "nowhere"), (79, "w3 " * 70)], "item_id bigint, text string")
    want = plain_ranking(docs.collect(), items.collect())
    for block_bytes, query_bytes in ((2000, 500), (16 << 20, 4 << 20)):
        index, n = ranked_search.build_index(docs, block_bytes=block_bytes)
        got = ranked_search.search(index, n, items, block_bytes=query_bytes)
        assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == want


def test_ranking_of_nothing(spark: SparkSession, empty: DataFrame, odd: DataFrame) -> None:
    none = spark.createDataFrame([], "item_id bigint, text string")
    asked = spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    for docs, items in ((empty, asked), (odd, none)):
        index, n = ranked_search.build_index(docs)
        assert ranked_search.search(index, n, items).count() == 0


def test_slices_add_and_rank() -> None:
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 20, 130), rng.integers(0, 1 << 12, 130)
    bits = lambda x, n: np.stack([ranked_search._packed((x >> k & 1).astype(np.uint8)) for k in range(n)])
    sums = bits(a, 24)
    ranked_search.add(sums, bits(b, 12), 3)
    want = a + (b << 3)
    query, doc, score = ranked_search.best(sums[:, None, :], 130, 7)
    top = sorted(range(130), key=lambda k: (-want[k], k))[:7]
    assert sorted(zip(doc.tolist(), score.tolist(), strict=True)) == sorted((k, int(want[k])) for k in top)
