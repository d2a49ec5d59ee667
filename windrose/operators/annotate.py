"""Labels from a model that answers in text: equal questions are asked once, answers are kept, and read whatever form they take.

The annotator is any function from a list of questions to a list of answers; it runs in the tasks, on batches. Answers are
stored under the SHA-256 of annotator name and question, so a run after a crash, or over a grown table, asks only what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Annotator = Callable[[list[str]], list[str | None]]
#: Questions of one call, how often a failed call is tried, and the code of an answer that says nothing.
BATCH, TRIES, NO_CODE = 50, 3, "CODE_99"
CACHE = "digest string, answer string"


def parsed(answer: Column) -> Column:
    """(code, reason) of an answer: JSON, alone, fenced as a block of code, or somewhere within text."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    text = F.when(fenced != "", fenced).otherwise(answer)
    #: From the first opening brace to the last closing one.
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.from_json(braces, "Delay_Code string, Reason string")
    code = F.when(F.length(F.trim(found["Delay_Code"])) > 0, F.trim(found["Delay_Code"]))
    return F.struct(F.coalesce(code, F.lit(NO_CODE)).alias("code"), F.when(code.isNotNull(), found["Reason"]).alias("reason"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    try:
        return spark.read.schema(CACHE).parquet(path).groupBy("digest").agg(F.max("answer").alias("answer"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def annotated(rows: DataFrame, question: Column, annotator: Annotator, name: str, path: str, batch: int = BATCH) -> DataFrame:
    """``rows`` with ``code`` and ``reason``; rows whose question is null are not asked and have neither.

    ``path`` is the folder of answers. An annotator that fails ``TRIES`` times on a batch leaves its questions without an
    answer for this run (code ``NO_CODE``); the next one asks them again.
    """
    asked = rows.withColumn("_question", question).withColumn("_digest", F.when(F.col("_question").isNotNull(), F.sha2(F.concat_ws("\x01", F.lit(name), "_question"), 256)))
    todo = asked.filter("_digest IS NOT NULL").groupBy(F.col("_digest").alias("digest")).agg(F.first("_question").alias("question")).join(_stored(rows, path), "digest", "left_anti")

    def answers(questions: list[str]) -> list[str | None]:
        for _ in range(TRIES):
            try:
                given = annotator(questions)
                if len(given) == len(questions):
                    return list(given)
            except Exception:  # noqa: BLE001, S112
                continue
        return [None] * len(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(0, part.num_rows, batch):
                digests, questions = (part.column(c)[k : k + batch] for c in ("digest", "question"))
                given = answers(questions.to_pylist())
                known = [i for i, a in enumerate(given) if a is not None]
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(known, pa.int64())), pa.array([given[i] for i in known], pa.string())], names=["digest", "answer"])

    todo.select("digest", "question").mapInArrow(run, CACHE).write.mode("append").parquet(path)
    known = _stored(rows, path).withColumn("_parsed", parsed(F.col("answer"))).select(F.col("digest").alias("_digest"), "_parsed")
    out = asked.join(known, "_digest", "left")
    said = F.col("_question").isNotNull()
    return out.select(*rows.columns, F.when(said, F.coalesce("_parsed.code", F.lit(NO_CODE))).alias("code"), F.col("_parsed.reason").alias("reason"))
