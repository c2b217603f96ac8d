"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meander.llm import centroids, fingerprints, htmlmodel, langid, lexical, licenses, minhash, mixing, neighbours
from meander.llm import packing, quality, secrets, simhash
from meander.llm.common import id_hash, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = (id_hash("doc_id") % 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.identify(docs, model, ["doc_id", held.alias("held_out")])


@query("op2_entropy_mix")
def op2_entropy_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark")


@query("op3_html_tree_model")
def op3_html_tree_model(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return htmlmodel.extract(pages, htmlmodel.fit(pages), ["page_id", "url"])


@query("op4_secret_ownership")
def op4_secret_ownership(spark, sf_dir):
    found = secrets.document_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
        secrets.digest(F.concat("base", "extra")).alias("spans"),
        F.col("n_live").cast("long").alias("n_live"), F.col("n_example").cast("long").alias("n_example"),
    )


@query("op5_harmonic_pack")
def op5_harmonic_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=vocabulary()).drop("class")


@query("op6_license_rules")
def op6_license_rules(spark, sf_dir):
    found = licenses.recognise(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"),
    )


@query("op7_byte_cnn_quality")
def op7_byte_cnn_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = (id_hash("doc_id") % 5) == 0
    net = quality.fit(docs.where(~held), labels.where(~held))
    return quality.classify(docs, net, ["doc_id", held.alias("held_out")])


@query("op8_kmeans_tree_search")
def op8_kmeans_tree_search(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op9_minhash_dedup")
def op9_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_multiset_fingerprint")
def op10_multiset_fingerprint(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op11_centroid_clusters", centroids.sql())
def op11_centroid_clusters(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_lexical_tree_search", lexical.sql())
def op12_lexical_tree_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_simhash_dedup")
def op13_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
