"""The rounds of the mix cost the driver few jobs, and windows and joins over a source's sizes find the same copies."""

import pytest

from meander.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"s{i % 7}" if i % 7 else None, "word " * (3 + i * i % 97)) for i in range(900)]
    return spark.createDataFrame([*rows, (900, "s1", None)], "doc_id long, source string, text string")


def test_few_jobs(spark, docs):
    sc = spark.sparkContext
    sc.setJobGroup("mix-jobs", "mix")
    try:
        rows = mixing.mix(docs).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 901
    assert len(sc.statusTracker().getJobIdsForGroup("mix-jobs")) <= 60


def test_joins_find_the_same(docs):
    key = lambda r: (r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken)
    assert sorted(map(key, mixing.mix(docs, group_limit=0).collect())) == sorted(map(key, mixing.mix(docs).collect()))
