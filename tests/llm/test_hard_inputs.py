"""Inputs that are hard on purpose: structured texts for hashes, long ones for patterns, names of containers, many ranges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from windrose.llm import decontaminate, html_text, neardup, pii, sharding
from windrose.llm.common import _PRIME, _product, prefix_sums, span_hash

ARTICLE = "<body><nav>menu</nav><article><header><h1>Title</h1></header><p>{0}</p><section class='{1}'><p>{2}</p></section><figure><figcaption>Cap</figcaption></figure></article><footer>f</footer></body>"


def thue_morse(n: int, zero: str, one: str) -> list[str]:
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def test_products_modulo_the_prime() -> None:
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, int(_PRIME), 2000, dtype=np.uint64) for _ in range(2))
    assert _product(a, b).tolist() == [x * y % int(_PRIME) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_spans_hash_alike_wherever_they_lie() -> None:
    data = np.frombuffer(b"xyz" * 3 + b"hello" + b"q" * 5000 + b"hello", np.uint8)
    for values in (data, data.astype(np.uint64) << np.uint64(50)):
        h = span_hash(prefix_sums(values), np.array([9, 5014, 8]), np.array([14, 5019, 13]))
        assert h[0] == h[1] != h[2]


def test_structured_texts_are_told_apart(spark: SparkSession) -> None:
    signs = [("".join(thue_morse(4096, *x)),) for x in (("!", "?"), ("?", "!"))]
    texts = [(" ".join(thue_morse(2048, *x)),) for x in (("p", "q"), ("q", "p"))]
    docs = spark.createDataFrame(signs + texts, "text string").withColumn("doc_id", F.monotonically_increasing_id())
    sizes = neardup.classes(docs).select("doc_id", "class_size").collect()
    # The words of the last two are the same shingles but for their counts; the signs have no words.
    assert len(sizes) == 4 and sum(r.class_size == 1 for r in sizes) >= 2
    item = spark.createDataFrame([(1, "".join(thue_morse(1024, "p", "q")) + " " + " ".join(["x"] * 9))], "item_id bigint, text string")
    text = "".join(thue_morse(1024, "q", "p")) + " " + " ".join(["x"] * 9)
    hit = decontaminate.search(decontaminate.build_index(spark.createDataFrame([(1, text)], "doc_id bigint, text string")), item).first()
    assert hit.n_hit == 0 and not hit.contaminated


@pytest.mark.parametrize("text", ["a@" + "b." * 500_000 + "com", "0123456789abcdef" * 65_536, "token=" + "x9" * 500_000, "Mr " + "A" + "b" * 1_000_000 + " Cd Ef", "1:" * 500_000, "+1 " * 300_000, "DE" + "12 3456" * 150_000, "Anna Maria " * 90_000, "a." * 500_000 + "@b"], ids=["email", "hex", "token", "name", "colons", "plus", "iban", "names", "dots"])
def test_long_shapes_pass(spark: SparkSession, text: str) -> None:
    out = pii.replaced(spark.createDataFrame([(1, text), (2, "Mail a@b.org")], "doc_id bigint, text string"), "k").orderBy("doc_id").collect()
    assert len(out) == 2 and "a@b.org" not in out[1].text


def test_long_domain_is_one_entity(spark: SparkSession) -> None:
    text = "x a@" + "b." * 2000 + "com y"
    out = pii.replaced(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
    assert out.n_entities == 1 and "b.b" not in out.text


def test_surnames_that_are_ordinary_words_stay(spark: SparkSession) -> None:
    text = "Mr Will went. Will we go? Then Will left, as Will said. Mrs May came in May 2020. May I ask May?"
    out = pii.replaced(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first().text
    will, may = out.split(" went")[0].removeprefix("Mr "), out.split("Mrs ")[1].split(" came")[0]
    assert will != "Will" and may != "May"
    assert out == f"Mr {will} went. Will we go? Then {will} left, as {will} said. Mrs {may} came in May 2020. May I ask {may}?"


@pytest.mark.parametrize("name", ["side-effects", "share-price", "comments-policy", "alert-levels", "related-work", "social-history", "menu-planning"])
def test_sections_of_an_article_stay(name: str) -> None:
    text = html_text.main_text(ARTICLE.format("word, " * 40, name, "prose " * 30))
    assert "prose" in text and text.startswith("Title") and text.endswith("Cap") and "menu" not in text


@pytest.mark.parametrize("name", ["related", "share-buttons", "commentList", "ad-slot-1", "related-posts", "newsletter-box"])
def test_boilerplate_of_an_article_goes(name: str) -> None:
    assert "prose" not in html_text.main_text(ARTICLE.format("word, " * 40, name, "prose " * 30))


def test_depth_has_no_limit() -> None:
    assert html_text.main_text("<div>" * 20_000 + "<p>one</p><p>two</p>") == "one\n\ntwo"
    assert html_text.main_text("<x>" * 20_000 + "</y>" * 20_000 + "<p>z") == "z"


def test_edges_are_found_by_halves(spark: SparkSession) -> None:
    edges = [3 * k for k in range(20_000)]
    rows = spark.range(-2, 60_010, 7).withColumn("n", sharding._at_most(edges, F.col("id"))).collect()
    assert all(r.n == int(np.searchsorted(edges, r.id, "right")) for r in rows)
    assert spark.range(1).select(sharding._at_most([], F.col("id"))).first()[0] == 0
