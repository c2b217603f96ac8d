"""The stored index: every row stored, pruned reads, recall against the exact search; running blocks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meander.functions.runtime import scratch_path
from meander.operators import chunk_index as ci
from meander.operators import retrieval

RNG = np.random.default_rng(11)
CENTERS = RNG.normal(size=(12, 8))
POINTS = CENTERS[RNG.integers(0, 12, 1500)] + 0.2 * RNG.normal(size=(1500, 8))
ASKS = CENTERS[RNG.integers(0, 12, 60)] + 0.2 * RNG.normal(size=(60, 8))


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(POINTS)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ASKS)], "query_id long, embedding array<double>")
    path = scratch_path(spark, "index")
    ci.build_index(chunks, path)
    return queries, chunks, path


def found(df):
    return {(r.query_id, r["rank"]): r.chunk_id for r in df.collect()}


def brute(k):
    d = np.round(1 - (ASKS @ POINTS.T) / np.linalg.norm(ASKS, axis=1)[:, None] / np.linalg.norm(POINTS, axis=1), 9)
    return {(i, r + 1): int(j) for i in range(len(ASKS)) for r, j in enumerate(np.lexsort((np.arange(len(POINTS)), d[i]))[:k])}


def test_every_row_is_stored_once(spark, tables):
    ids = [r.chunk_id for r in ci._stored(spark, tables[2]).select("chunk_id").collect()]
    assert sorted(ids) == list(range(1500))
    assert spark.read.parquet(f"{tables[2]}/centers").agg(F.sum("n")).first()[0] == 1500


@pytest.mark.parametrize("small", [0, ci.SMALL_CELLS])
def test_all_cells_equal_brute_force(tables, small):
    got = ci.search_index(tables[0], tables[2], 3, probes=ci.MAX_CELLS, small_cells=small, block_rows=16)
    assert found(got) == brute(3)


@pytest.mark.parametrize("small", [0, ci.SMALL_CELLS])
def test_calibrated_probes_reach_recall_and_prune(tables, small):
    queries, _, path = tables
    probes = ci.calibrate_probes(queries, path)
    assert probes < 20
    got = ci.search_index(queries, path, 3, probes, small_cells=small)
    want = brute(3)
    best = found(got)
    sets = lambda d: {(q, c) for (q, _), c in d.items()}
    assert len(sets(best) & sets(want)) / len(want) >= 0.9
    one = ci.search_index(queries.filter("query_id = 0"), path, 3, 2)
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN \(\d+,\d+\)", one._jdf.queryExecution().executedPlan().toString())


def test_rows_without_direction_are_stored_but_never_found(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.9, 0.1])]
    path = scratch_path(spark, "index")
    ci.build_index(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), path)
    assert ci._stored(spark, path).count() == 6
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert found(ci.search_index(asks, path, 5, probes=9)) == {(1, 1): 1, (1, 2): 6}
    assert ci.calibrate_probes(asks.limit(1), path) >= 1


def test_empty_index(spark):
    path = scratch_path(spark, "index")
    empty = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    ci.build_index(empty, path)
    asks = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert ci.search_index(asks, path).count() == 0


def test_stripes_share_one_running_result(tables, monkeypatch):
    """Few rows leave a task: k per query and stripe, not per chunk block."""
    queries, chunks, _ = tables
    for stripe in (1, 4, 256):
        monkeypatch.setattr(retrieval, "STRIPE_BLOCKS", stripe)
        assert found(retrieval.vector_topk(queries, chunks, 3, block_rows=50, small_cells=0)) == brute(3)
    best = retrieval._against_blocks(
        queries, chunks, 3, "query_id", "chunk_id", "embedding", "query_id long, chunk_id long, distance double", 60, 50
    )
    assert best.count() == 3 * 60


def test_a_vector_stands_once_however_many_cells_it_asks_for(spark, tables):
    queries, _, path = tables
    probed = ci._probed(queries, ci._centers(spark, path), ci.MAX_CELLS)
    assert probed.count() == len(ASKS)


@pytest.mark.parametrize("probes", [2, ci.MAX_CELLS])
def test_blocks_and_stripes_find_what_shipped_queries_find(tables, monkeypatch, probes):
    monkeypatch.setattr(ci, "BLOCK_NUMBERS", 80)
    monkeypatch.setattr(ci, "STRIPE_BLOCKS", 1)
    want = ci.search_index(tables[0], tables[2], 3, probes)
    got = ci.search_index(tables[0], tables[2], 3, probes, small_cells=0, block_rows=10)
    assert found(got) == found(want)


def test_nearest_puts_ties_and_undefined_distances_in_order():
    c = np.vstack([np.tile([1.0, 0.0], (5, 1)), [[np.nan, np.nan]], [[0.0, 1.0]]])
    d, ids = retrieval._nearest(np.array([[1.0, 0.0], [np.nan, np.nan]]), c, np.array([9, 4, 7, 1, 8, 0, 2]), 3)
    assert ids[0].tolist() == [1, 4, 7] and d[0].tolist() == [0, 0, 0] and np.isnan(d[1]).all()
