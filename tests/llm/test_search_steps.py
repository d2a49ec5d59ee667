"""The index of the ranked search is made in steps that hold little."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from windrose.llm import common, ranked_search


def test_a_block_is_hashed_in_small_steps(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """No step hashes over a megabyte, and the block's index equals that of one step over all of its text."""
    made, sizes = [], []
    monkeypatch.setattr(ranked_search, "statistics", lambda *_: (3000, 600_000))
    monkeypatch.setattr(ranked_search, "map_arrow", lambda df, fn, schema: made.append(fn) or df)
    monkeypatch.setattr(ranked_search, "written", lambda df, name: df)
    ranked_search.build_index(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    monkeypatch.setattr(ranked_search, "words", lambda data, ends: sizes.append(len(data)) or common.words(data, ends))
    texts = [None if i % 50 == 0 else f"only{i} alpha beta " * (i % 7) + "gamma delta " * 100 for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([(i * 7) % 3000 for i in range(3000)], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    small = list(made[0](batch))
    assert len(small) == 1 and len(sizes) > 3 and max(sizes) <= 1 << 20
    monkeypatch.setattr(ranked_search, "text_chunks", lambda b, c, limit=1 << 30: common.text_chunks(b, c, limit))
    whole = list(made[0](batch))
    assert len(whole) == 1 and sizes[-1] > 3 << 20 and small[0].equals(whole[0])
