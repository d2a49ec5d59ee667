"""A sink that takes each key once, whatever is replayed.

Every batch has a folder of its own, named by the batch's number, and writing it again replaces it, so a batch that is
replayed after a crash adds nothing. Keys that other batches have brought are left out, so a restart with a new checkpoint
goes on where the table ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, with the number of each row's batch; None where there is none yet."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_batch(batch: DataFrame, number: int, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """One batch: of rows with equal keys one, without those of other batches, worked on and written in place of itself."""
    fresh, before = batch.dropDuplicates(list(keys)), stored(batch.sparkSession, path)
    if before is not None:
        others = before.filter(F.col(BATCH) != number).select(*keys).distinct()
        same = F.lit(True)
        for i, k in enumerate(keys):
            others = others.withColumnRenamed(k, f"_k{i}")
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        fresh = fresh.join(others, same, "left_anti")
    work(fresh).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def append_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame] = lambda df: df, first: int = 0, once: bool = True) -> StreamingQuery:
    """Start appending ``stream``; ``once``: what there is by now, else until it is stopped.

    A stream with a new ``checkpoint`` counts its batches from 0 again; ``first`` puts them behind those that are there.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, first + number, path, keys, work)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
