"""Tables of web pages against rows written by hand; bundles against the preparation that they come from."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession

from windrose.operators import learning, serving
from windrose.sources import html_tables

PAGES = {
    "plain": ("<table><tr class=a><td>1</td><td> 2 <b>x</b></td></tr></table>", [(0, 0, "a", ["1", "2 x"], [None, None])]),
    "unclosed": ("<TABLE><tr><td>1<td>2<tr><th>3", [(0, 0, None, ["1", "2"], [None, None]), (0, 1, None, ["3"], [None])]),
    "nested": ("<table><tr><td>a<table><tr><td>in</table>b<td>c</table>", [(0, 0, None, ["ab", "c"], [None, None]), (1, 0, None, ["in"], [None])]),
    "spans": ("<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d<tr><td>e</table>", [(0, 0, None, ["a", "b", "b"], [None] * 3), (0, 1, None, ["a", "c", "d"], [None] * 3), (0, 2, None, ["e"], [None])]),
    "covered": ("<table><tr><td>a<td rowspan=3>z<tr><tr></table>", [(0, 0, None, ["a", "z"], [None, None]), (0, 1, None, [None, "z"], [None, None]), (0, 2, None, [None, "z"], [None, None])]),
    "struck": ("<table><tr><td><div class='x del'>10:00</div><div class=d-none>no</div>10:30<br>late<script>x</script></table>", [(0, 0, None, ["10:30 late"], ["10:00"])]),
    "stray": ("</td></table><td>no<table><td>1</tr></tr></table></table>&amp;<table></table>", [(0, 0, None, ["1"], [None])]),
    "charrefs": ("<table><tr><td>a&amp;b&nbsp;c<td rowspan=x colspan=0>d", [(0, 0, None, ["a&b c", "d"], [None, None])]),
    "none": ("<p>no table</p>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_rows_of_tables(name: str) -> None:
    reader = html_tables._Reader()
    reader.feed(PAGES[name][0])
    assert reader.finished() == PAGES[name][1]


def test_table_function_over_pages(spark: SparkSession) -> None:
    pages = spark.createDataFrame([*((k, v[0]) for k, v in PAGES.items()), ("null", None), ("empty", "")], "page_id string, html string").repartition(3)
    got = {}
    for r in html_tables.table_rows(pages).collect():
        got.setdefault(r.page_id, []).append((r.table, r.row, r.row_class, r.cells, r.struck))
    assert {k: sorted(v, key=lambda r: r[:2]) for k, v in got.items()} == {k: v[1] for k, v in PAGES.items() if v[1]}


def test_a_bundle_makes_the_vectors_of_its_preparation(spark: SparkSession, tmp_path: Path) -> None:
    rows = [(float(i % 7) if i % 5 else None, i % 3, "abc"[i % 3] if i % 4 else None, "same", float(i % 11)) for i in range(300)]
    train = learning.as_inputs(spark.createDataFrame(rows, "n double, m int, w string, v string, y double"), ["n", "m"], ["w", "v"], "y")
    model = learning.fitted(train, "boosted_quantile", ["n", "m"], ["w", "v"], n_trees=3, max_depth=2)
    serving.bundled(model).save(spark, str(tmp_path / "bundle"))
    bundle = serving.load(spark, str(tmp_path / "bundle"))
    forms = spark.createDataFrame([(1.0, 2, "a", "same", 0.0), (None, None, None, None, 0.0), (float("nan"), 1, "new", "other", 0.0)], "n double, m int, w string, v string, y double")
    batch = model.transform(learning.as_inputs(forms, ["n", "m"], ["w", "v"], "y")).select("n", "m", "w", "v", vector_to_array("features").alias("want"), "prediction")
    served = bundle.vectors(batch).collect()
    assert len(served) == 3 and len(bundle.features()) == len(served[0].want)
    for r, form in zip(served, forms.collect(), strict=True):
        assert r.x == r.want == bundle.vector(form.asDict())
        assert abs(bundle.predict(form.asDict()) - r.prediction) < 1e-9
    assert bundle.vector({}) == bundle.vector({"n": "no number", "w": None})
