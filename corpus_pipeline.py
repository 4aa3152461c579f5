"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows its predecessor kept and is written to the shared
folder before the next one reads it, so a lost executor costs at most one stage.
Only the last returns other columns than those of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import decontaminate, near_dup, quality, toxicity
from feedlake.llm.common import checked, new_folder, settled, table
from feedlake.llm.queries import decontaminated, packed_documents
from feedlake.session import configure

#: A list of up to so many ids to remove is broadcast; a longer one is joined
#: by shuffling the documents.
REMOVED_ROWS = 500_000

#: Words of a shingle in the near-duplicate stage, the same as in the operator's query.
SHINGLE_WORDS = near_dup.SHINGLE_WORDS

#: No SQL expresses the classifiers, the registers or the packing.
ORACLE_SQL = None


def unused(name: str, docs: DataFrame) -> str:
    """``name``, with underscores until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  A null text counts as
    empty; rows of one id are judged each by its own text; without labels to learn
    from all stay."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality_of(model, F.col("text")) >= quality.CUT)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject.  Null texts, repeated ids
    and missing labels as in ``good_quality``."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity_of(model, F.col("text")) < toxicity.CUT)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (shingles of ``SHINGLE_WORDS``
    words): the smallest id.  A document is an id with a text: rows equal in both
    are copies, of which the first by the other columns stays; texts of one id are
    judged apart; rows without an id are judged as well.  Documents of a shared or
    null id come after all others.  Documents without words are linked with nothing."""
    key = unused("row_key", docs)
    keyed = _with_keys(docs, key)
    found = near_dup.near_duplicates(keyed.select(key, "text"), size=SHINGLE_WORDS, id_col=key)
    gone = settled(found.filter("not kept").select(key), "near-gone")
    return keyed.join(checked(gone, REMOVED_ROWS), key, "left_anti").select(*docs.columns)


def _with_keys(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a long ``key`` per document: its id, where the id has one row.
    The rest, reduced to one row per id and text, is numbered beyond all ids."""
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = settled(several.filter("n > 1").select("doc_id"), "near-repeated")
    hint = checked(several, REMOVED_ROWS)
    nameless = docs.filter("doc_id is null")
    shared = docs.join(hint, "doc_id", "left_semi").select(*docs.columns).unionByName(nameless)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = F.min(F.struct(*rest)) if rest else F.lit(None)
    one = shared.groupBy("doc_id", "text").agg(others.alias("r"))
    columns = [F.col("r")[c].alias(c) if c in rest else F.col(c) for c in docs.columns]
    # written before they are joined to, so that their numbers are read, not made again
    numbered = settled(one.select(F.monotonically_increasing_id().alias(key), *columns), "near-numbered")
    single = docs.filter("doc_id is not null").withColumn(key, F.col("doc_id").cast("long"))
    if numbered.isEmpty():
        return single
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).head()
    beyond = 0 if high is None else high + 1
    number = F.col(key) + beyond if beyond < 1 << 62 else F.lit(low - 1) - F.col(key)
    single = single.join(hint, "doc_id", "left_anti")
    return single.select(key, *docs.columns).unionByName(numbered.withColumn(key, number))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no notable part of the benchmark.  Null and empty texts
    stay; rows of one id are judged each by its own text."""
    key = unused("row_key", docs)
    judged = decontaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = settled(judged.filter("contaminated").select(F.col("key").alias(key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, decontaminate.document_key(F.col("doc_id"), F.col("text")))
    same = keyed[key].eqNullSafe(gone[key])
    return keyed.join(checked(gone, REMOVED_ROWS), same, "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into training sequences."""
    return packed_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("best_fit_packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
