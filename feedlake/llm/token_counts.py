"""Token counts through a cache of digests.

A text's count is looked up by (content digest, tokenizer version).  Only
distinct digests that the cache lacks are encoded, and their counts are
appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.llm.common import arrow_rows, settled

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def tokenizer_version(model: str) -> str:
    """Digest of the vocabulary file and of how it is applied."""
    import sentencepiece
    import tokenizers

    own = sentencepiece.__version__ if model.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(Path(model).read_bytes() + f"|{own}|plain".encode()).hexdigest()


def encoder(model: str):
    """texts -> counts, by sentencepiece for .model and tokenizers for .json,
    without added special tokens, truncation or padding."""
    if model.endswith(".model"):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda texts: [len(x) for x in loaded.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(model)
    loaded.no_truncation()
    loaded.no_padding()
    return lambda texts: [len(x.ids) for x in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def _counts_udf(model: str):
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(model)
        for texts in batches:
            out: list[int] = []
            for at in range(0, len(texts), 64):
                out += encode(texts.iloc[at : at + 64].tolist())
            yield pd.Series(out, dtype="int64")

    return count


def normalised(text):
    """What is counted and digested: the text as it is, null as empty.  Any
    further normalisation is the tokenizer's own, so counts stay exact."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark, path: str) -> DataFrame:
    """The cache below ``path``; empty if nothing was stored yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, model: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_tokens, digest).

    The job first appends the counts of unknown digests to the Parquet folder
    ``cache``, then returns the join with it.  Texts are reduced to one per
    digest before and after the shuffle, so a text that a third of all rows
    repeat is shipped once per task and encoded once.  Two jobs that append at
    the same time may store a digest twice, with the same count; reading takes
    one.  Null texts count as empty; null ids and repeated rows stay; an empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    version = tokenizer_version(model)
    text = normalised(F.col(text_col))
    digest = F.sha2(text, 256)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = docs.select(digest.alias("digest"), text.alias("_text")).dropDuplicates(["digest"])
    misses = misses.join(known.select("digest").distinct(), "digest", "left_anti")
    misses.select(
        F.lit(version).alias("tokenizer"), "digest", _counts_udf(model)("_text").alias("n_tokens")
    ).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    # stored first: without an aggregation beside the join, AQE can split a hot digest
    counts = settled(counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")
    rows = docs.select(
        F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")
    )
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", "digest")
