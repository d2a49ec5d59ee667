"""Page text and surrogates against plain versions that follow their descriptions."""

from __future__ import annotations

import random

import regex
from pyspark.sql import SparkSession

from windrose.llm import html_text, pii

SF = "/root/testdata/sf0.001"
WORDS = "the quick, brown fox jumps over a lazy dog and so on, until".split()


class Box:
    """An element of a made-up page: a tag, and texts (with whether they are in a link) and boxes inside."""

    def __init__(self, tag: str, inside: list) -> None:
        self.tag, self.inside, self.up = tag, inside, None
        for x in inside:
            if isinstance(x, Box):
                x.up = self

    def html(self) -> str:
        return f"<{self.tag}>" + "".join(x.html() if isinstance(x, Box) else f"<a href=x>{x[0]}</a>" if x[1] else x[0] for x in self.inside) + f"</{self.tag}>"

    def boxes(self) -> list[Box]:
        return [self, *(b for x in self.inside if isinstance(x, Box) for b in x.boxes())]

    def blocks(self) -> list[tuple[Box, str, int]]:
        """Runs of text between boxes, in page order, with the characters in links."""
        out, run = [], []

        def end() -> None:
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                out.append((self, text, sum(len(t.strip()) for t, linked in run if linked)))
            run.clear()

        for x in self.inside:
            if isinstance(x, Box):
                end()
                out.extend(x.blocks())
            else:
                run.append(x)
        end()
        return out


def made(rng: random.Random, depth: int) -> Box:
    inside: list = []
    for _ in range(rng.randint(1, 4)):
        if depth and rng.random() < 0.6:
            inside.append(made(rng, depth - 1))
        else:
            inside.append(Box(rng.choice(["p", "p", "h2", "ul"]), [(" ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 10, 60]))), rng.random() < 0.25)]))
    return Box(rng.choice(["div", "div", "section", "article", "main"]), inside)


def plain_text(root: Box) -> str:
    """The scoring by its description, every sum taken anew from the blocks."""
    blocks, boxes = root.blocks(), root.boxes()

    def above(b: Box) -> list[Box]:
        return [b, *(above(b.up) if b.up else [])]

    size = {id(b): sum(len(t) for o, t, _ in blocks if b in above(o)) for b in boxes}
    linked = {id(b): sum(n for o, _, n in blocks if b in above(o)) for b in boxes}
    points = {id(b): 0.0 for b in boxes}
    for owner, text, n in blocks:
        gain = (1 + text.count(",") + min(3, len(text) // 100)) * (1 - min(1.0, n / len(text)))
        start = owner if owner.tag in ("article", "main", "body", "html", "section", "div") else owner.up
        for k, b in enumerate(above(start)):
            points[id(b)] += gain / 2**k
    score = {id(b): points[id(b)] * (1 - linked[id(b)] / max(1, size[id(b)])) for b in boxes}
    if not any(points.values()):
        return "\n\n".join(t for _, t, _ in blocks)
    order = [root]
    for b in order:
        order.extend(x for x in b.inside if isinstance(x, Box))
    best = max((b for b in order if points[id(b)] > 0), key=lambda b: score[id(b)])
    line = above(best)
    best = next((b for b in reversed(line) if b.tag == "article"), best)
    line = line[line.index(best) :]
    mains = [k for k, b in enumerate(line) if b.tag == "main"]
    poor = len(line) > 1 and linked[id(line[1])] < 0.25 * size[id(line[1])]
    top = line[mains[-1]] if mains and mains[-1] else line[1] if poor and best.tag != "main" else best
    kept, lists = {id(top)}, set()
    for inner, outer in zip(line, line[1 : line.index(top) + 1], strict=False):
        lists |= {id(x) for x in outer.inside if isinstance(x, Box) and x is not inner and linked[id(x)] >= 0.5 * max(1, size[id(x)])}
    if top is best and best.up is not None:
        for x in best.up.inside:
            if isinstance(x, Box) and x is not best and size[id(x)]:
                prose = x.tag in ("p", "h1", "h2", "blockquote", "pre") and linked[id(x)] / size[id(x)] < 0.25 and (size[id(x)] >= 80 or x.tag in ("h1", "h2"))
                if score[id(x)] >= 0.2 * score[id(best)] or prose:
                    kept.add(id(x))
    out = []
    for owner, text, _ in blocks:
        mark = next((b for b in above(owner) if id(b) in kept or id(b) in lists), None)
        if mark is not None and id(mark) in kept:
            out.append(text)
    return "\n\n".join(out)


def test_page_text_equals_plain_scoring() -> None:
    rng, whole, part = random.Random(11), 0, 0
    for _ in range(400):
        root = Box("html", [Box("body", [made(rng, 3) for _ in range(rng.randint(1, 3))])])
        want = plain_text(root)
        assert html_text.main_text(root.html()) == want
        everything = "\n\n".join(t for _, t, _ in root.blocks())
        whole, part = whole + (want == everything), part + (want != everything)
    assert whole > 20 and part > 100


def plain_parts(text: str) -> list[str]:
    """The text cut at its mentions, texts between at even places."""
    pattern = pii.PATTERN if regex.search(pii.GUARD, text) else pii.UNGUARDED
    pattern = regex.compile(pattern.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    parts, at = [], 0
    for m in pattern.finditer(text):
        parts += [text[at : m.start()], m[0]]
        at = m.end()
    return [*parts, text[at:]]


def test_surrogates_stand_at_the_mentions_and_nowhere_else(spark: SparkSession) -> None:
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and pii.MARK not in r.text}
    out = {r.doc_id: r for r in pii.replaced(spark.read.parquet(f"{SF}/documents.parquet"), "k").collect()}
    said: dict[str, set[str]] = {}
    mentions = named = 0
    for doc_id, text in rows.items():
        parts, new = plain_parts(text), out[doc_id].text
        if any(regex.match(rf"(?:(?:{pii._ANY_TITLE})\.?\s|(?:{pii._ANY_GIVEN})[ -])\p{{L}}", m) for m in parts[1::2]):
            # Surnames that stand alone are cut as well; that part has tests of its own.
            named += 1
            continue
        assert out[doc_id].n_entities == len(parts) // 2
        found = regex.fullmatch("(.+?)".join(regex.escape(p) for p in parts[::2]), new, regex.DOTALL)
        assert found, doc_id
        for was, now in zip(parts[1::2], found.groups(), strict=True):
            assert was != now
            said.setdefault(was, set()).add(now)
            mentions += 1
        if len(parts) == 1:
            assert new == text
    assert mentions > 20 and named < len(rows) // 2
    # One entity, one surrogate; and no two share one.
    assert all(len(x) == 1 for x in said.values())
    assert len({x for v in said.values() for x in v}) == len({regex.sub(r"[ ().-]", "", k).lower() for k in said})


def test_scores_are_calibrated_on_held_out_rows(spark: SparkSession) -> None:
    """In every fifth of the held-out rows by score, the share of good ones is near the mean score."""
    from windrose.llm import classifier

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.classify(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "quality").dropna().orderBy("score").collect()
    assert len(rows) > 300
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        assert abs(sum(r.score for r in part) - sum(r.quality for r in part)) < 0.12 * len(part)
    base = sum(r.quality for r in rows) / len(rows)
    assert sum((r.score - r.quality) ** 2 for r in rows) < 0.8 * len(rows) * base * (1 - base)
