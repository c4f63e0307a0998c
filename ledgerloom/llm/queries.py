"""The thin queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, html_extract, hyperminhash, language, mixing, mtree, packing, rare_digest, toxicity, url_filter, variants, warc
from .common import cut, drop_path, fresh_path, held_out, small_batches, table


def tokenizer_files(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and the pattern that splits text for it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.col("tox_examples").alias("evidence"),
        F.col("tox_similarity").alias("similarity"),
    )


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hyperminhash.near_duplicates(docs, words=2, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sources = F.array("source")
    mix = mixing.solve(docs, sources, F.col("doc_id"), F.col("text"))
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    totals = mix.totals.withColumnRenamed("source", "_source")
    return (
        mixing.copies(sized, mix, sources, F.col("doc_id"))
        .join(F.broadcast(totals), F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = html_extract.train(html_extract.labelled_pages())
    text = html_extract.extract(pages, model).drop("html")
    return text.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = mtree.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, path, pattern, decoded=True).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Host and path rules of the query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_urls())
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "junk")


def op9_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_digest.compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    small_batches(spark, 128)
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"), path)
    back = cut(warc.read_archives(spark, path, with_payload=False), "records")
    drop_path(spark, path)
    return warc.whole(back).select(
        F.col("rec_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, clusters = centroids.k_means(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed=2)
    named = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = tokenizer_files("word_bpe_49k.json")
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), path, capacity=4096, end=1, keep_ids=False)
    return packing.pack(pieces, capacity=4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return variants.spelling_variants(docs, least_length=5, least_count=3, ratio=2, delete_every=97).select("word", "form", "root", "n", "n_near", "form_n")


#: Scores from here on count as toxic.
TOXIC_AT = 0.7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_html": op5_html,
    "op6_mtree": op6_mtree,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_rare_digest": op9_rare_digest,
    "op10_warc": op10_warc,
    "op11_centroids": op11_centroids,
    "op12_packing": op12_packing,
    "op13_variants": op13_variants,
}
