"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose feature lies beyond a cutoff. Per stratum (language), one half of the labelled
documents orders the cutoffs of all rules into a path from the least harmful to the strictest. On the other half, the
holdout, the path is walked while the exact binomial (Clopper-Pearson) upper bound on the rate of good documents that
the cutoffs so far reject together is at most ``RISK``. Walking a fixed order and stopping at the first failure needs no
correction along the path; over the strata the level is divided (Bonferroni), so with probability ``1 - ALPHA`` no
stratum loses more than ``RISK`` of those of its good documents that pass the base conditions.

A document whose base conditions fail is rejected whatever its stratum. Null texts have no words and so fail. The null
stratum is one like the others. Strata whose labels are too few for any bound have no cutoffs, only the base conditions.
Labels without quality are ignored, of repeated labels the higher counts. A text counts once in a stratum, with the highest
of its labels and in one half alone, so that copies and repeated documents are no draws of their own; all are judged. Texts of any
length are judged whole. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, text_chunks, written

#: Accepted rate of rejected good documents of each stratum, and the probability that any bound fails.
RISK, ALPHA = 0.01, 0.05
MIN_WORDS, REPEAT_PERCENT = 50, 50
UNNAMED = "\x00null"

SYMBOLS = b"#*$%&|<>"
FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

#: By rule: the feature, from the text counts, and its cutoffs from lenient to strict; a feature above the cutoff rejects.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05]),
    "duplicate_lines": ("n_dup_lines / n_lines", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "repeated_words": ("n_repeat_words / n_words", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "exclamations": ("n_exclaim / n_words", [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "long_words": ("word_chars / n_words", [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
    "capitals": ("n_upper / word_chars", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
}
EXTRA = "n_lines bigint, n_exclaim bigint, n_upper bigint"
COUNTS = [c.split()[0] for c in f"{FEATURES}, {EXTRA}".split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    numbers: dict[tuple, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in windows])
    twice = np.bincount(ids)[ids] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` of one text; words are split at ASCII white space."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    joined = b"".join(words)
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words), len(joined.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), text.count(b"!"), upper)


def _counted(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in text_chunks(batch, "text"):
        raw = data.tobytes()
        yield np.array([counts(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(hi - lo, len(COUNTS))


def features(docs: DataFrame, stratum: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, stratum and the counts of every whole text; ``carry`` adds the text and the other columns as c0, c1, ..."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if carry))
    given = [c for c in rows.columns if carry or c != "text"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([*_counted(batch), np.zeros((0, len(COUNTS)), np.int64)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*given, *COUNTS])

    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join([*(f"{c} {kinds[c]}" for c in given), FEATURES, EXTRA]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rule_value(rule: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below)), F.lit(0.0))


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a rate: the p at which ``rejected`` or fewer of n have probability ``level``."""
    if rejected >= n:
        return 1.0
    k = np.arange(rejected + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k])
    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = choose + k * math.log(p) + (n - k) * math.log1p(-p) if 0 < p < 1 else np.array([-math.inf])
        if np.exp(terms - terms.max()).sum() * math.exp(terms.max()) > level:
            low = p
        else:
            high = p
    return high


def ordered_path(cells: pd.DataFrame) -> list[tuple[str, float]]:
    """(rule, cutoff) from the least harmful: by good documents beyond the cutoff, then by bad ones, most first.

    Cutoffs that reject no more bad documents than good ones beyond the one before are left out.
    """
    entries = []
    for rule, part in cells.groupby("rule"):
        grid, before = RULES[rule][1], (0, 0)
        for k, cutoff in enumerate(grid):
            beyond = part[part.beyond >= len(grid) - k]
            good, bad = int(beyond.good.sum()), int(beyond.bad.sum())
            if bad - before[1] > good - before[0]:
                entries.append((good, -bad, rule, cutoff))
                before = (good, bad)
    return [(rule, cutoff) for _, _, rule, cutoff in sorted(entries)]


def certified_steps(good_at: dict[int, int], n_good: int, n_steps: int, level: float, risk: float) -> int:
    """How many steps of the path stand: rejected good documents are bounded step by step until a bound fails."""
    rejected = 0
    for step in range(n_steps):
        rejected += good_at.get(step, 0)
        if not n_good or upper_bound(rejected, n_good, level) > risk:
            return step
    return n_steps


def thresholds(found: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(stratum, rule, cutoff): learnt from the documents that pass the base conditions; UNNAMED stands for the null stratum.

    One half of the labelled texts, by a hash of the text, orders the path; the other half is the holdout that certifies it.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    rows = found.filter(~base_failed()).join(known, "doc_id")
    rows = rows.groupBy(F.coalesce("stratum", F.lit(UNNAMED)).alias("stratum"), "text_key").agg(F.max("quality").alias("quality"), F.first(F.array(*map(rule_value, RULES))).alias("values"))
    rows = rows.select("stratum", "quality", (F.xxhash64("text_key", F.lit("half")) % 2 == 0).alias("holdout"), "values")
    rows = written(rows, "labelled")
    level = alpha / max(1, rows.agg(F.count_distinct("stratum").alias("n")).first().n)

    def exceeded(i: int, grid: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c < F.get("values", F.lit(i))))

    beyond = F.array(*(F.struct(F.lit(r).alias("rule"), exceeded(i, RULES[r][1]).alias("beyond")) for i, r in enumerate(RULES)))
    cells = rows.filter(~F.col("holdout")).select("stratum", "quality", F.explode(beyond).alias("x")).groupBy("stratum", "x.rule", "x.beyond").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))

    def order(part: pd.DataFrame) -> pd.DataFrame:
        path = ordered_path(part)
        return pd.DataFrame({"stratum": [part.stratum.iloc[0]] * len(path), "step": [*range(len(path))], "rule": [r for r, _ in path], "cutoff": [c for _, c in path]}, dtype=object)

    path = written(cells.groupBy("stratum").applyInPandas(order, "stratum string, step int, rule string, cutoff double"), "path")
    at = F.coalesce(*(F.when(F.col("rule") == r, F.lit(i)) for i, r in enumerate(RULES)))
    steps = path.groupBy("stratum").agg(F.collect_list(F.struct(at.alias("at"), "cutoff", "step")).alias("path"))
    beaten = F.array_min(F.transform(F.filter("path", lambda p: F.element_at("values", p["at"] + 1) > p["cutoff"]), lambda p: p["step"]))
    reached = rows.filter("holdout AND quality = 1").join(steps, "stratum", "left").groupBy("stratum", F.coalesce(beaten, F.lit(-1)).alias("first"), F.coalesce(F.size("path"), F.lit(0)).alias("n_steps")).agg(F.count("*").alias("good"))

    def certify(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part.good.sum())
        stands = certified_steps(dict(zip(part["first"], part.good, strict=True)), n, int(part.n_steps.iloc[0]), level, risk)
        return pd.DataFrame({"stratum": [part.stratum.iloc[0]], "stands": [stands]}, dtype=object)

    stands = reached.groupBy("stratum").applyInPandas(certify, "stratum string, stands int")
    return stands.join(path, "stratum", "left").groupBy("stratum", "rule").agg(F.min(F.when(F.col("step") < F.col("stands"), F.col("cutoff"))).alias("cutoff"))


def verdicts(found: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``found`` with base_failed and kept."""
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    #: Strata come by a join on their name.
    wide = written(wide.withColumnRenamed("stratum", "_stratum"), "cutoffs")
    both = found.join(wide, F.coalesce(found["stratum"], F.lit(UNNAMED)) == F.col("_stratum"), "left")
    kept = ~base_failed()
    for r in RULES:
        kept &= ~F.coalesce(rule_value(r) > F.col(f"cut_{r}"), F.lit(False))
    return both.withColumn("base_failed", base_failed()).withColumn("kept", kept)


def learnt_cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The written counts of every document, and the cutoffs."""
    found = written(features(docs, stratum), "features")
    return found, thresholds(found, labels)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The counts of every document, whether its base conditions fail and whether it is kept."""
    return verdicts(*learnt_cutoffs(docs, labels, stratum)).select("doc_id", *[c.split()[0] for c in FEATURES.split(", ")], "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that are kept, with the columns that they came with."""
    _, cutoffs = learnt_cutoffs(docs, labels, stratum)
    #: Counting again costs less than dealing out the texts to meet their verdicts.
    return verdicts(features(docs, stratum, carry=True), cutoffs).filter("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
