"""Verdicts of the quality rules against a plain reading of the method."""

from __future__ import annotations

import random
from math import comb

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from windrose.llm import quality_rules as q


def text_of(rng: random.Random, spoilt: float) -> str:
    words = prose(rng.randrange(1 << 30), rng.randint(45, 90)).split()
    symbols = [w + "#" * rng.randint(1, 3) if rng.random() < spoilt else w for w in words]
    lines = [" ".join(symbols[k : k + 12]) for k in range(0, len(symbols), 12)]
    return "\n".join(lines + [lines[0]] * (rng.randint(2, 9) if rng.random() < spoilt else 0)) + "!" * rng.choice((0, 0, int(60 * spoilt)))


def plain_verdicts(rows: list[tuple], labels: dict[int, int], held: dict[str, bool]) -> dict[int, bool]:
    found = {i: dict(zip(q.COUNTS, q.counts((t or "").encode()), strict=True)) for i, t, _ in rows}
    failed = {i: f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for i, f in found.items()}

    def value(f: dict, rule: str) -> float:
        above, below = q.RULES[rule][0].split(" / ")
        return f[above] / f[below] if f[below] else 0.0

    by_text: dict[str | None, dict[str, list]] = {}
    for i, t, lang in rows:
        if not failed[i] and i in labels:
            known = by_text.setdefault(lang, {}).setdefault(t, [0, found[i]])
            known[0] = max(known[0], labels[i])
    kept, level = {}, q.ALPHA / max(1, len(by_text))
    for lang in {x[2] for x in rows}:
        known = by_text.get(lang, {})
        path = []
        for rule, (_, grid) in q.RULES.items():
            before = (0, 0)
            for cutoff in grid:
                beyond = [quality for t, (quality, f) in known.items() if not held[t] and value(f, rule) > cutoff]
                good, bad = sum(beyond), len(beyond) - sum(beyond)
                if bad - before[1] > good - before[0]:
                    path.append((good, -bad, rule, cutoff))
                    before = (good, bad)
        path = [(rule, cutoff) for _, _, rule, cutoff in sorted(path)]
        good = [f for t, (quality, f) in known.items() if held[t] and quality]
        stands = 0
        while stands < len(path) and good:
            lost = sum(any(value(f, rule) > cutoff for rule, cutoff in path[: stands + 1]) for f in good)
            #: The exact bound is at most RISK where so few losses have at most that probability at a rate of RISK.
            if sum(comb(len(good), k) * q.RISK**k * (1 - q.RISK) ** (len(good) - k) for k in range(lost + 1)) > level:
                break
            stands += 1
        for i, _, at in rows:
            if at == lang:
                kept[i] = not failed[i] and not any(value(found[i], rule) > cutoff for rule, cutoff in path[:stands])
    return kept


def test_verdicts_follow_the_method(spark: SparkSession) -> None:
    rng = random.Random(8)
    rows, labels = [], {}
    for i in range(3600):
        bad = rng.random() < 0.3
        text = rows[rng.randrange(i)][1] if i and rng.random() < 0.1 else text_of(rng, rng.uniform(0.1, 0.9) if bad else rng.choice((0, 0, 0, 0.02)))
        rows.append((i, text, rng.choice(("en", "en", "en", "de", None)) if i % 50 else "fr"))
        if rng.random() < 0.9:
            labels[i] = int(not bad)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = spark.createDataFrame([(i, x, 0) for i, x in labels.items()], "doc_id bigint, quality int, toxic int")
    held = {r.text: r.held for r in docs.select("text", (F.xxhash64(F.xxhash64("text"), F.lit("half")) % 2 == 0).alias("held")).collect()}
    found = {r.doc_id: r.kept for r in q.judge(docs, known).collect()}
    expected = plain_verdicts(rows, labels, held)
    assert found == expected and 0.3 < sum(found.values()) / len(rows) < 0.95
