"""Dense search by cells: vectors are kept with the nearest of some centroids, a query looks into a few cells and scores them exactly.

Centroids are fitted on at most ``SAMPLE`` vectors (those with the smallest hash of their keys), every vector is kept in its
cell, and scores are exact dot products, so the only loss is that of cells a query doesn't look into: ``recall`` measures it against
``retrieval.dense_all``, which stays the exact way. A centroid matrix goes to the tasks; its size follows ``most_cells`` and the width.
Rows and queries meet by an equi-join on the cell, as blocks, so a crowded cell is many blocks and no group.

One index serves one width; vectors of another width, null vectors and vectors with a null element are in no cell, and queries of
another width have no result (``dense_all`` serves several widths). An empty table gives an empty index.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.retrieval import QUERY_BLOCK, ROW_BLOCK, _best, _packed
from waymark.sources.scratch import kept
from waymark.sources.shipping import ship

#: Vectors that centroids are fitted on, passes of the fit, and cells at most.
SAMPLE, PASSES, MOST_CELLS = 20_000, 8, 1024
#: The share of exact results that the chosen number of cells finds on the sample, the depth of these, and the vectors that ask.
AIM, AIM_DEPTH, AIM_QUERIES = 0.95, 30, 200


class Cells(NamedTuple):
    """``centroids``: a matrix, a row a cell; ``probes``: the cells that a query looks into; ``blocks``: cell, width, keys, data."""

    centroids: object
    probes: int
    blocks: DataFrame


def _sound(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.filter((F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull()))


def fit(embeddings: DataFrame, width: int, sample: int = SAMPLE, most_cells: int = MOST_CELLS):
    """(centroids, probes): float64, a row a cell, about the root of the number of vectors, by Lloyd's passes over a bounded sample.

    ``probes`` is the smallest number of cells that gives vectors of the sample ``AIM`` of their exact results within it: few where
    vectors crowd, most of them where they point everywhere.
    """
    import numpy as np

    rows = _sound(embeddings, width)
    n = rows.count()
    got = rows.orderBy(F.xxhash64("doc_key"), "doc_key").limit(sample).select("doc_key", "embedding").collect()
    data = np.array([r["embedding"] for r in got], float).reshape(-1, width)
    k = max(1, min(most_cells, len(data), round(n**0.5)))
    centres = data[np.linspace(0, max(len(data) - 1, 0), k).astype(int)] if len(data) else np.zeros((1, width))
    for _ in range(PASSES if len(data) else 0):
        near = _nearest(data, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, data)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    if not len(data):
        return centres, 1
    asked = data[:: max(1, len(data) // AIM_QUERIES)][:AIM_QUERIES]
    best = np.argsort(-(asked @ data.T), axis=1, kind="stable")[:, :AIM_DEPTH]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, _nearest(data, centres)[best], axis=1).reshape(-1))
    return centres, int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1


def _nearest(data, centres):
    return (-2 * data @ centres.T + (centres**2).sum(1)).argmin(1)


def _with_cells(vectors: DataFrame, key: str, centres, pick) -> DataFrame:
    """cell, key, embedding: a row for each cell that ``pick`` names for a block of vectors (rows of cell numbers)."""
    ship(vectors.sparkSession)
    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                found = pick(np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1), shared.value)
                at = np.repeat(np.arange(part.num_rows), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).astype("int32")), *part.take(pa.array(at)).columns], ["cell", key, "embedding"])

    return rows.mapInArrow(run, f"cell int, {key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def build(embeddings: DataFrame, width: int, sample: int = SAMPLE, most_cells: int = MOST_CELLS) -> Cells:
    """The index of embeddings (doc_key, embedding) of one width."""
    centres, probes = fit(embeddings, width, sample, most_cells)
    rows = _with_cells(_sound(embeddings, width), "doc_key", centres, lambda data, c: _nearest(data, c)[:, None])
    rows = rows.repartitionByRange("cell", F.xxhash64("doc_key")).sortWithinPartitions("cell", "doc_key")
    return Cells(centres, probes, kept(_packed(rows, "doc_key", ROW_BLOCK), "cells"))


def search(index: Cells, queries: DataFrame, depth: int, probes: int | None = None) -> DataFrame:
    """(query_id, doc_key, score): the best dot products in the ``probes`` cells whose centroids have the largest ones."""
    cells, width = index.centroids.shape
    many = min(cells, probes or index.probes)

    def pick(data, centres):
        import numpy as np

        return np.argsort(-(data @ centres.T), axis=1, kind="stable")[:, :many]

    asked = _with_cells(_sound(queries, width), "query_id", index.centroids, pick).repartition("cell").sortWithinPartitions("cell", "query_id")
    return _best(_packed(asked, "query_id", QUERY_BLOCK), index.blocks, queries, depth, lambda q, rows: q.join(rows, "cell"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's exact results that were found."""
    hits = exact.select("query_id", "doc_key").join(found.select("query_id", "doc_key", F.lit(1).alias("hit")), ["query_id", "doc_key"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
