"""Dense search by cells: recall against the exact way, few cells where vectors crowd."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import cells
from waymark.operators import retrieval as R
from waymark.plans import reading_queries as Q


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_recall_of_the_registered_query(spark, sf):
    found, exact = Q.match_meaning_cells(spark, sf), Q.match_meaning_all(spark, sf)
    per = [r.recall for r in cells.recall(found, exact).collect()]
    assert per and sum(per) / len(per) >= 0.9
    assert found.join(exact.withColumnRenamed("score", "s"), ["query_id", "doc_key"]).filter("abs(score - s) > 1e-6").count() == 0


def test_crowds_need_few_cells_and_other_rows_are_left_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 10
    data = [(f"d{i:04d}", [float(x) for x in centres[i % 30] + rng.normal(size=16)]) for i in range(1500)]
    odd = [("n", None), ("e", []), ("w", [1.0] * 5), ("h", [None] + [1.0] * 15)]
    rows = spark.createDataFrame(data + odd, "doc_key string, embedding array<double>")
    asked = spark.createDataFrame([(i, data[i * 7][1]) for i in range(20)] + [(98, None), (99, [1.0] * 5)], "query_id long, embedding array<double>")
    index = cells.build(rows, 16)
    assert index.probes < len(index.centroids) / 4
    assert index.blocks.agg(F.sum(F.size("keys"))).first()[0] == 1500
    found = cells.search(index, asked, 30)
    per = {r.query_id: r.recall for r in cells.recall(found, R.dense_all(rows, asked.filter("query_id < 90"), 30)).collect()}
    assert len(per) == 20 and sum(per.values()) / 20 >= 0.9
    assert found.filter("query_id > 90").count() == 0
    empty = cells.build(rows.limit(0), 16)
    assert cells.search(empty, asked, 3).count() == 0
