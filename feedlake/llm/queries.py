"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import (
    centroids,
    chat,
    decontaminate,
    mixing,
    near_dup,
    neighbours,
    packing,
    pitman_yor,
    quality,
    token_counts,
    toxicity,
    url_filters,
    vector_codes,
)
from feedlake.llm.common import new_folder, settled, table
from feedlake.session import configure

#: op1: the rules of the url filter.
URL_RULES = [
    url_filters.Rule("allow", "com/"),
    url_filters.Rule("block", "example.com/en/"),
    url_filters.Rule("allow", "www.example.com/en/"),
    url_filters.Rule("block", "net/es/"),
    url_filters.Rule("block", "net/fr/"),
]
TOKEN_LIMIT = 4096
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules and by what its aliases say."""
    configure(spark)
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted through a cache that starts empty."""
    configure(spark)
    counts = token_counts.token_counts(
        table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), new_folder(spark, "token-cache")
    )
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Documents as packed pieces; the ids themselves are reduced to a checksum."""
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), END_ID)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.packed(settled(pieces, "pieces"), order=("doc_id", "piece", "ids_crc32"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    configure(spark)
    return packed_documents(table(spark, sf_dir, "documents"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with the figures of the contamination rule, and its key."""
    key = decontaminate.document_key(F.col("doc_id"), F.col("text"))
    counts, pairs = decontaminate.contamination(docs, benchmark)
    listed = pairs.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ","), 256).alias("items_sha256"),
    )
    rows = docs.select("doc_id", key.alias("key"), F.size(decontaminate.words_of(F.col("text"))).cast("long").alias("n_words"))
    found = counts.join(listed, "key")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, rows["key"].eqNullSafe(found["key"]), "left").select(
        rows["key"],
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of the benchmark."""
    configure(spark)
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a hierarchical Pitman-Yor model."""
    configure(spark)
    return pitman_yor.text_scores(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from preference pairs."""
    configure(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by class-conditional models."""
    configure(spark)
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, as components."""
    configure(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    configure(spark)
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    configure(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in sixteen clusters."""
    configure(spark)
    return centroids.cluster_report(centroids.clustered(table(spark, sf_dir, "embeddings")))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    configure(spark)
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix.select("doc_id", "size", "source_size", "target", taken)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code, its error and its label's."""
    configure(spark)
    report = vector_codes.code_report(vector_codes.coded(table(spark, sf_dir, "embeddings")))
    return report.drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_source_mixing": op12_source_mixing,
    "op13_vector_codes": op13_vector_codes,
}
