"""The history's commit log: half an append is never seen, numbers come from the log."""

import pytest
from pyspark.sql import functions as F

from meander.functions.runtime import scratch_path
from meander.schemas import HISTORY
from meander.sources import commits
from meander.sources import history as hs


def records(spark, ids, bad=False):
    rows = [(i, "r", 86400.0 * 40 * n, None, [], {}) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, HISTORY)
    if bad:  # the second record fails while the first is written
        stop = F.when(F.col("record_id") == ids[-1], F.raise_error(F.lit("stopped"))).otherwise(F.col("run_id"))
        df = df.withColumn("run_id", stop.cast("string"))
    return df


def ids(spark, path, **kw):
    return sorted(r.record_id for r in hs.history_scan(spark, path, **kw).collect())


def test_failed_append_leaves_the_store_as_it_was(spark):
    path = scratch_path(spark, "history")
    hs.history_append(records(spark, ["a", "b"]), path)
    before = hs.next_seq(spark, path)
    with pytest.raises(Exception, match="stopped"):
        hs.history_append(records(spark, ["c", "d"], bad=True), path)
    assert ids(spark, path) == ["a", "b"] and hs.next_seq(spark, path) == before
    # files that some killed writer left behind belong to no commit
    spark.createDataFrame([('{"record_id": "x", "run_id": "r"}',)], "value string").write.text(f"{path}/batch=lost")
    assert ids(spark, path) == ["a", "b"]
    hs.history_append(records(spark, ["e"]), path)
    assert ids(spark, path) == ["a", "b", "e"]


def test_numbers_come_from_the_log_and_grow(spark):
    path = scratch_path(spark, "history")
    for part in (["a", "b", "c"], [], ["d"], ["e", "f"]):
        hs.history_append(records(spark, part), path)
        top = hs.history_scan(spark, path).agg(F.max("seq")).first()[0]
        assert hs.next_seq(spark, path) == top + 1
    seqs = {r.record_id: r.seq for r in hs.history_scan(spark, path).collect()}
    assert [i for i, _ in sorted(seqs.items(), key=lambda x: x[1])] == list("abcdef")
    assert len(set(seqs.values())) == 6


def test_clear_and_compact(spark):
    path = scratch_path(spark, "history")
    hs.history_append(records(spark, ["a", "b"]), path)
    hs.history_append(records(spark, ["c"]), path)
    number = hs.next_seq(spark, path)
    before = sorted(hs.history_scan(spark, path).select("record_id", "seq", "timestamp").collect())
    hs.history_compact(spark, path)
    assert len(commits.live_batches(spark, path)) == 1
    assert sorted(hs.history_scan(spark, path).select("record_id", "seq", "timestamp").collect()) == before
    assert ids(spark, path, since=86400.0) == ["b"]
    hs.history_clear(spark, path)
    assert ids(spark, path) == [] and hs.next_seq(spark, path) == number
    hs.history_append(records(spark, ["z"]), path)
    assert ids(spark, path) == ["z"] and hs.history_scan(spark, path).first().seq >= number


def test_lines_without_a_log_are_taken_over(spark):
    path = scratch_path(spark, "lines")
    lines = ['{"record_id": "a", "run_id": "r", "timestamp": 5.0, "seq": 41}', "{broken", "", '{"record_id": "b", "run_id": "r"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    assert ids(spark, path) == ["a", "b"] and hs.next_seq(spark, path) == 42
    hs.history_append(records(spark, ["c"]), path)
    assert ids(spark, path) == ["a", "b", "c"]
    assert hs.rejected_lines(spark, path).count() == 1
    assert hs.history_scan(spark, path).filter("record_id = 'c'").first().seq >= 42
