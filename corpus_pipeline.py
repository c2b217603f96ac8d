"""From raw documents to packed sequences: language ID, near-dedup, secret masking, mixing, packing.

``STAGES`` lists (name, function); every function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of documents.

* language_id drops texts without language (null, or no letter) and those whose best language is hardly above chance.
* near_dedup keeps one document of each group of near copies, the one with the smallest id.
* secret_scan masks secrets inside the texts; no document goes.
* mix repeats or drops documents so that every source comes to its target share of words.
* pack tokenises what is there and packs it into sequences; its rows are pieces.

Rows with a null doc_id are documents like others; repeated rows are near copies of each other, rows that share an id
but not the text are not.  An empty table gives an
empty result with the same columns.  There is no SQL for the whole: it learns, draws and tokenises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meander.llm import catalog, langid, minhash, mixing, packing, secrets
from meander.llm.common import materialised, table

#: A language stays if its calibrated probability is at least this.
MIN_SCORE = 0.3
#: Near copies have at least this percentage of their word shingles in common.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    # the row in one column, so that no name of it meets those of the result
    found = langid.identify(docs, model, [F.struct(*docs.columns).alias("row")])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, percent=NEAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary=catalog.vocabulary()).drop("class")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
