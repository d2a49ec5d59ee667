"""Each operator against a plain version, and on odd and empty tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from windrose.llm import classifier, decontaminate, html_text, masked_lm, neardup, packing, pii, quality_rules, sharding

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def frame(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s", None, None, None, None) for i, t in enumerate(texts)], SCHEMA)


# 1
def test_pii_is_replaced_alike_everywhere(spark: SparkSession) -> None:
    texts = ["Write to Ann.Lee@Mail.com or call +49 170 1234567, card 4111 1111 1111 1111.", "again ann.lee@mail.com", "Mrs Mary Weber came. Weber left; MARY stayed.", "plain \x01 text 10.1.2.3 end", None, "", "nothing here"]
    rows = {r.doc_id: r for r in pii.replaced(frame(spark, texts), "k").collect()}
    mails = [re.findall(r"[^ ]+@[^ ,]+", rows[i].text)[0] for i in (0, 1)]
    assert mails[0].lower() == mails[1].lower() != "ann.lee@mail.com"
    assert re.search(r"call \+4\d \d{3} \d{7}, card (\d{4} ){3}\d{4}\.$", rows[0].text) and "4111 1111 1111 1111" not in rows[0].text
    digits = [int(x) for x in re.search(r"card ([\d ]+)\.", rows[0].text)[1].replace(" ", "")]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    name = re.match(r"Mrs (\w+) (\w+) came\. (\w+) left", rows[2].text)
    assert name[2] == name[3] != "Weber" and name[1] != "Mary"
    assert rows[3].text.startswith("plain \x01 text ") and "10.1.2.3" not in rows[3].text
    assert [rows[i].text for i in (4, 5, 6)] == [None, "", "nothing here"] and rows[6].n_entities == 0


def test_pii_neighbours_stay_apart(spark: SparkSession) -> None:
    lone = ["+1 (826) 555-4081", "+49 170 1234567", "4111 1111 1111 1111", "6212 3456 7890 1234 567"]
    texts = [*lone, *(f"{x} 190.137.223.204" for x in lone), f"{lone[2]} 42 items", f"{lone[2]} 123 items", f"{lone[0]} 2024", f"{lone[1]} 2024"]
    rows = {r.doc_id: r for r in pii.replaced(frame(spark, texts), "k").collect()}
    drawn = [rows[i].text for i in range(4)]
    assert all(a != b and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(drawn, lone, strict=True))
    addresses = {rows[4 + i].text.removeprefix(drawn[i] + " ") for i in range(4)}
    assert len(addresses) == 1 and re.fullmatch(r"2[45]\d(\.\d+){3}", addresses.pop())
    assert [rows[i].text for i in range(8, 12)] == [f"{drawn[2]} 42 items", f"{drawn[2]} 123 items", f"{drawn[0]} 2024", f"{drawn[1]} 2024"]
    assert [rows[i].n_entities for i in range(12)] == [1] * 4 + [2] * 4 + [1] * 4


def test_pii_of_wider_forms_is_found(spark: SparkSession) -> None:
    found = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "0" * 4 + "ab" * 70, "030 12345678", "01 23 45 67 89", "020 7946 0958", "+33 1 23 45 67 89", "Juan Carlos García López"]
    texts = [*(f"see {x} end" for x in found), 'x {"password": "hunter2hunter2"} y', "Juan Carlos García López came. García and López left.", "std::cout a::b x :: y Foo::bar at 12:30"]
    rows = {r.doc_id: r for r in pii.replaced(frame(spark, texts), "k").collect()}
    for i, x in enumerate(found):
        inside = rows[i].text.removeprefix("see ").removesuffix(" end")
        assert rows[i].n_entities == 1 and inside != x and not set(re.findall(r"\w{5,}", x)) & set(re.findall(r"\w+", inside))
    assert all(rows[i].text.startswith("see 2001:db8:") for i in range(3)) and rows[4].text.startswith("see 0") and rows[5].text.startswith("see 0")
    assert re.fullmatch(r'x \{"password": "\w{14}"\} y', rows[9].text) and "hunter2" not in rows[9].text
    names = re.fullmatch(r"(\w+) (\w+) (\w+) (\w+) came\. (\w+) and (\w+) left\.", rows[10].text)
    assert names and (names[3], names[4]) == (names[5], names[6]) and not {*names.groups()} & {"Juan", "Carlos", "García", "López"}
    assert rows[11].text == texts[11]


def test_pii_surrogates_are_distinct(spark: SparkSession) -> None:
    entities = spark.createDataFrame([("given_m_latin", f"name{i}") for i in range(3000)], "kind string, canonical string")
    drawn = pii.entity_surrogates(entities, "k").collect()
    assert len({r.surrogate for r in drawn}) == len({r.canonical for r in drawn}) == 3000


def test_pii_draws_end_where_formats_are_full(spark: SparkSession) -> None:
    small = [("email", f"{c}@mail.com") for c in "abcdefghijklmnopqrstuvwxyzé"] + [("phone_country", f"+49{k:03d}") for k in range(1000)] + [("ssn", f"{k:02d}") for k in range(100)] + [("ipv4", "1.2.3.4")]
    drawn = pii.entity_surrogates(spark.createDataFrame(small, "kind string, canonical string"), "k").collect()
    assert len(drawn) == len(small) == len({(r.kind, r.surrogate) for r in drawn}) and not {(r.kind, r.surrogate) for r in drawn} & set(small)
    assert {r.surrogate for r in drawn} != {r.surrogate for r in pii.entity_surrogates(spark.createDataFrame(small, "kind string, canonical string"), "other").collect()}
    texts = [" ".join(f"{c}@mail.com" for c in "abcdefghijklmnopqrstuvwxyzé"), "to a@mail.com and b@mail.com"]
    rows = [r.text.split() for r in pii.replaced(frame(spark, texts), "k").orderBy("doc_id").collect()]
    assert len(set(rows[0])) == 27 and rows[1] == ["to", rows[0][0], "and", rows[0][1]]


# 2
def test_shards_are_even_and_gapless(spark: SparkSession, odd: DataFrame) -> None:
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count()
    for s in {r.shard for r in rows}:
        part = [r.slot for r in rows if r.shard == s]
        assert sorted(part) == list(range(len(part)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(docs).collect()
    sizes, largest = Counter(), max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    given = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32((given[r.doc_id] or "").encode()) and r.size == len((given[r.doc_id] or "").encode()) + 1 for r in rows)


def test_equal_rows_are_cut_too(spark: SparkSession) -> None:
    rows = [(None, None)] * 700 + [(1, "same " * 20)] * 40 + [(i, prose(i, 15)) for i in range(60)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), range_rows=5).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len(found) == 800 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found))) for s in range(8))


# 3
def test_quality_counts_and_base(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_only_certified_strata_have_cutoffs(spark: SparkSession) -> None:
    spoilt = lambda k: " ".join(w + "#" * 3 for w in prose(k, 60).split())
    rows = [(i, spoilt(i) if i % 3 == 0 else prose(i, 60), lang, "s", None, None, None, None) for lang, first, n in (("en", 0, 3000), ("de", 3000, 90), (None, 3090, 90)) for i in range(first, first + n)]
    rows += [(4000 + i, rows[3000 + i % 90][1], "de", "s", None, None, None, None) for i in range(3000)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows if r[0] < 4000] + [(4000 + i, int((3000 + i % 90) % 3 > 0), 0) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert all(kept[i] == (i % 3 > 0) for i in range(3000)) and all(kept[i] for i in kept if i >= 3000)


def test_exact_bound_and_fixed_sequence() -> None:
    from math import comb

    for k, n, level in ((0, 50, 0.05), (3, 80, 0.01), (10, 200, 0.025)):
        p = quality_rules.upper_bound(k, n, level)
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(level, rel=1e-6)
    assert quality_rules.certified_steps({0: 0, 1: 50}, 1000, 3, 0.05, 0.01) == 1
    assert quality_rules.certified_steps({}, 0, 3, 0.05, 0.01) == 0


# 4
def test_masked_lm_prefers_learnt_order(spark: SparkSession) -> None:
    rng = random.Random(1)
    lines = ["the cat sat on the mat and the dog ran to the house".split() for _ in range(300)]
    shuffled = [rng.sample(x, len(x)) for x in lines[:20]]
    rows = {r.doc_id: r for r in masked_lm.likelihoods(frame(spark, [" ".join(x * 5) for x in lines] + [" ".join(x) for x in shuffled] + [None])).collect()}
    assert np.mean([rows[i].mean_log_likelihood for i in range(300)]) > np.mean([rows[300 + i].mean_log_likelihood for i in range(20)])
    assert rows[320].n_words == 0 and rows[320].log_likelihood == 0


def test_masked_lm_within_classes(spark: SparkSession) -> None:
    rng = random.Random(6)
    heads, tails = prose(1, 150).split(), prose(2, 150).split()
    lines = [" ".join(x for k in rng.sample(range(150), 12) for x in (("red" if k % 2 else "blue"), heads[k], tails[k])) for _ in range(200)]
    texts = frame(spark, lines).select("text")
    vocabulary = masked_lm.Vocabulary(masked_lm.bucket_counts(texts))
    counts = masked_lm.neighbour_counts(texts.repartition(5), vocabulary)
    for side in (0, 1):
        assert counts[side].sum() == sum(len(x.split()) for x in lines)
    assert (counts == masked_lm.neighbour_counts(texts.repartition(40), vocabulary)).all()
    found = masked_lm.Neighbours(counts, vocabulary)
    for c in (3, 50, 60, 63):
        members = np.flatnonzero(vocabulary.class_of == c)
        for left, right in ((0, 1), (64, 7), (55, 64)):
            p = np.exp(vocabulary.log_share[members] + found.of(members, np.full(len(members), c), np.full(len(members), left), np.full(len(members), right)))
            assert p.sum() == pytest.approx(1, abs=1e-3)


def test_masked_lm_trains_on_every_word(spark: SparkSession) -> None:
    texts = frame(spark, ["one two three four", "five", "six seven"] * 20).select("text")
    assert not np.array_equal(masked_lm.train(texts, masked_lm.Vocabulary(masked_lm.bucket_counts(texts))).flat, masked_lm.Network.drawn().flat)
    row = np.repeat(np.arange(200), 17)
    dealt = masked_lm.masked_in(np.arange(len(row)) % 31 * (row + 1), row, 2)
    assert set(dealt) == {0, 1} and 0.4 < dealt.mean() < 0.6 and all(len(set(dealt[k::17])) == 2 for k in range(17))


# 5
def near_classes(texts: list[str]) -> list[int]:
    def bag(text: str) -> Counter:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags, of = [bag(t) for t in texts], list(range(len(texts)))
    sums = [sum(b.values()) for b in bags]
    for i, j in combinations(range(len(texts)), 2):
        both = bags[i].keys() & bags[j].keys()
        score = sum(1 / sum(max(bags[i][z] / bags[i][x], bags[j][z] / bags[j][x]) for z in bags[i].keys() | bags[j].keys()) for x in both) if len(both) * 3 > min(sums[i], sums[j]) else 0
        if score >= 0.8:
            of = [min(of[i], of[j]) if c in (of[i], of[j]) else c for c in of]
    return of


def test_near_duplicate_classes(spark: SparkSession) -> None:
    rng, texts = random.Random(3), []
    for k in range(25):
        words = prose(100 + k, rng.randint(60, 200)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = "zz"
            texts.append(" ".join(changed))
    found = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == near_classes(texts)


def test_one_of_each_class_stays(odd: DataFrame) -> None:
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7]


def test_no_text_is_lost_with_its_doc_id(spark: SparkSession) -> None:
    a, b, c, d = (prose(60 + k, 40) for k in range(4))
    rows = [(5, a), (5, b), (None, c), (None, c), (7, d), (8, d), (8, d), (9, ""), (9, ""), (10, None), (None, None), (5, a + " end")]
    table = spark.createDataFrame([(i, t, "en", "clash", "clash", 1) for i, t in rows], "doc_id bigint, text string, label string, node string, _id string, _n int")
    kept = neardup.deduplicated(table)
    assert kept.columns == table.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    one = {(5, a), (5, a + " end")} & found.keys()
    assert len(one) == 1 and found == Counter([*one, (5, b), (None, c), (7, d), (9, ""), (10, None), (None, None)])
    assert neardup.deduplicated(table.limit(0)).count() == 0


def test_blocks_of_a_hot_bucket(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rng, base, texts = random.Random(4), prose(7, 150).split(), []
    for _ in range(40):
        changed = list(base)
        for _ in range(rng.choice((1, 2, 4, 5))):
            changed[rng.randrange(len(changed))] = "".join(rng.choice("qwxyz") for _ in range(6))
        texts.append(" ".join(changed) + (" end" * rng.choice((1, 1, 6))))
    expected = near_classes(texts)
    for block in (neardup.BLOCK, 3):
        monkeypatch.setattr(neardup, "BLOCK", block)
        found = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
        assert [found[i] for i in range(len(texts))] == expected
    assert 1 < len(set(expected)) < len(texts)


def test_every_two_of_a_bucket_meet(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(neardup, "BLOCK", 4)
    nodes = [bytes([k]) for k in range(30)]
    label = lambda k: nodes[0] if k < 14 else nodes[k]
    members = spark.createDataFrame([(nodes[k], label(k), 7) for k in range(30)], "node binary, label binary, bucket bigint")
    sets = spark.createDataFrame([(n, bytes(100)) for n in nodes], "node binary, shingles binary")
    met = set()
    for deal in (neardup.within_blocks, neardup.across_blocks):
        groups: dict[tuple, list] = {}
        for r in deal(members, neardup.mixed_buckets(members, sets)).collect():
            groups.setdefault((r.i, r.j), []).append((bytes(r.node), r.own))
        met |= {(a, b) for g in groups.values() for (a, x), (b, y) in combinations(sorted(g), 2) if x != y or x < 0}
    assert {(a, b) for a, b in combinations(nodes, 2) if label(a[0]) != label(b[0])} <= met


def test_block_links_connect_what_all_pairs_connect() -> None:
    rng = np.random.default_rng(5)
    for k in range(6):
        base = np.arange(200, dtype=np.uint64)
        sets = []
        for _ in range(40):
            keep = np.sort(rng.choice(base, 200 - rng.integers(0, 45), replace=False))
            sets.append((keep, rng.integers(1, 2 + k % 3, len(keep)).astype(float)))
        label, side = rng.integers(0, 30, 40), rng.integers(0, 2, 40) if k % 2 else np.full(40, -1)

        def joined(pairs: list[tuple[int, int]], label=label) -> list[int]:  # noqa: ANN001
            of = label.tolist()
            for i, j in pairs:
                of = [min(of[i], of[j]) if c in (of[i], of[j]) else c for c in of]
            return of

        found = neardup.block_links(sets, label, side)
        every = [(i, j) for i, j in combinations(range(40), 2) if (side[i] != side[j] or side[i] < 0) and neardup.similarity(*sets[i], *sets[j]) >= 0.8]
        assert joined(found) == joined(every) and len(found) < len(set(label.tolist()))


# 7
def test_decontamination_near_and_exact(spark: SparkSession) -> None:
    item = prose(9, 14)
    w = item.split()
    texts = [f"start {item.upper()}! end", " ".join(w[:5] + ["extra"] + w[5:10]), prose(10, 40), None, "short one"]
    items = spark.createDataFrame([(7, item), (8, "short one"), (9, None), (None, ""), (7, item)], "item_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.search(decontaminate.build_index(frame(spark, texts)), items).collect()}
    assert [found[i].n_hit for i in range(5)] == [14, 0, 0, 0, 2] and found[0].n_items == 1
    assert found[1].n_near > 0 and found[2].n_near == 0
    assert [r.doc_id for r in decontaminate.decontaminated(frame(spark, texts), items).orderBy("doc_id").collect()] == [1, 2, 3]


def test_decontamination_holds_one_block_of_items(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    long = [prose(40 + k, 30) for k in range(6)]
    texts = [*long, f"{long[0]} and {long[3]}", prose(90, 50), None, "short one"]
    items = spark.createDataFrame([*((k % 4, x) for k, x in enumerate(long)), (8, "short one"), (None, long[5])], "item_id bigint, text string")
    index = decontaminate.build_index(frame(spark, texts))
    whole = sorted(decontaminate.search(index, items).collect(), key=lambda r: r.doc_id)
    held, most, broadcast = set(), [], spark.sparkContext.broadcast

    def counted(value: object) -> object:
        b = broadcast(value)
        destroy = b.destroy
        held.add(id(b))
        most.append(len(held))
        monkeypatch.setattr(b, "destroy", lambda: (held.discard(id(b)), destroy()), raising=False)
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    split = sorted(decontaminate.search(index, items, block_bytes=300).collect(), key=lambda r: r.doc_id)
    assert split == whole and [r.n_hit for r in whole[:7]] == [30] * 6 + [60] and len(most) > 1 and max(most) == 1


# 8
def test_packing_round_trip(spark: SparkSession) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [prose(k, n) for k, n in enumerate((1, 30, 700, 5000, 60, 61, 62))] + [None, "", "Ünïcode — test!! a.b c_d", "<|endoftext|> x"]
    rows = packing.pack(frame(spark, texts), TOKENIZER, with_ids=True).collect()
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids and all(r.doc_tokens == len(ids) and r.length == len(r.ids) for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


# 9
def test_classifier_held_out(spark: SparkSession) -> None:
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.7


# 10
def test_main_text() -> None:
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div id="main"><article><h1>Title</h1><p>First &amp; foremost, a long   paragraph, with commas, and enough words to count as prose here.</p>
    <p>Second paragraph, also long enough, with <b>inline</b> markup and a <a href="x">link</a>, to be kept.<script>var x;</script></p></article></div>
    <div class="comments"><p>A reader, who says much, and writes, with commas, about everything at length.</p></div><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page) == "Title\n\nFirst & foremost, a long paragraph, with commas, and enough words to count as prose here.\n\nSecond paragraph, also long enough, with inline markup and a link, to be kept."
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("plain") == "plain"


def test_main_text_of_other_page_shapes() -> None:
    long = "".join(f"<p>Paragraph {k}, with commas, and words, that go on, and on, for long enough to be prose, as anybody would say here.</p>" for k in range(6))
    plain = re.sub("<p>", "", long).replace("</p>", "\n\n").strip()
    rest = "<h3>More</h3><ul><li>One</li><li>Two</li></ul><p>Short.</p>"
    said = plain + "\n\nMore\n\nOne\n\nTwo\n\nShort."
    for page in (f"<article><section>{long}</section><section>{rest}</section></article>", f"<main><div>{long}</div>{rest}</main>", f"<div><section>{long}</section>{rest}</div>"):
        assert html_text.main_text(f"<html><body><nav>Menu</nav>{page}</body></html>") == said
    for name in ("content with-sidebar", "post has-comments"):
        page = f"<body><div class='{name}'>{long}<div class='comments'>{long}{long}</div></div><div class='sidebar'>Side</div></body>"
        assert html_text.main_text(page.replace(long + long, "<p>Me too</p>")) == plain
    assert html_text.main_text("<body><div class='comments'><p>All there is.</p></div></body>") == "All there is."
    deep = f"<article><p>Start.</p>{'<div>' * 450}<p>Low.</p><nav>Menu</nav>{'</div>' * 450}{long}</article><div class='sidebar'>Side</div>"
    assert html_text.main_text(deep).split("\n\n", 2) == ["Start.", "Low.", plain]


def test_pages_as_a_table(spark: SparkSession) -> None:
    long = "<article>" + "<p>Words, and words, and many more words, so that it is an article.</p>" * 2000 + "</article>"
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "plain", "x"), (2, "v", long, "x"), (2, "v", long, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    said = "\n\n".join(["Words, and words, and many more words, so that it is an article."] * 2000)
    assert Counter(map(tuple, found.collect())) == Counter([(1, "u", "", 0)] * 2 + [(None, None, "plain", 5)] + [(2, "v", said, len(said))] * 2)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_packs_are_filled_shortest_first() -> None:
    rng = random.Random(2)
    for _ in range(20):
        histogram = Counter(rng.choice((rng.randint(1, 30), rng.randint(1, 100), 100)) for _ in range(200))
        packs: list[list[int]] = []
        for length in sorted(histogram.elements(), reverse=True):
            least = min(packs, key=sum, default=None)
            if least is None or sum(least) + length > 100:
                packs.append([length])
            else:
                least.append(length)
        found = packing.patterns(histogram, 100)
        assert Counter({tuple(p): 0 for _, p in found}).keys() and sum((Counter({x: c * p.count(x) for x in set(p)}) for c, p in found), Counter()) == histogram
        assert all(sum(p) <= 100 for _, p in found) and abs(sum(c for c, _ in found) - len(packs)) <= max(1, len(packs) // 50)


APPLIED = {
    "pii": lambda d, x: pii.replaced(d, "k"), "sharding": lambda d, x: sharding.shard(d), "rules": quality_rules.judge, "lm": lambda d, x: masked_lm.likelihoods(d), "neardup": lambda d, x: neardup.classes(d),
    "decontaminate": lambda d, x: decontaminate.search(decontaminate.build_index(d), x.select(F.col("doc_id").alias("item_id"), F.lit("a b c").alias("text"))), "pack": lambda d, x: packing.pack(d, TOKENIZER), "classifier": classifier.classify,
}


@pytest.mark.parametrize("name", APPLIED)
def test_odd_and_empty_tables(name: str, odd: DataFrame, empty: DataFrame, labels: DataFrame) -> None:
    assert APPLIED[name](odd, labels).select("doc_id").distinct().count() == 9
    assert APPLIED[name](empty, labels.limit(0)).count() == 0
