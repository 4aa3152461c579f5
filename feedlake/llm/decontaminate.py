"""Benchmark decontamination by winnowed fingerprints.

Native DataFrame code only.  Every window of consecutive words keeps the
smallest hash of its k-grams.  A span that two texts share and that is as long
as a window has the same k-grams in both, so both keep the same fingerprint of
it: no shared window is missed.  Fingerprints of documents and benchmark are
joined; each hit is then extended along its alignment by comparing words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import ascii_lower, checked, settled

#: Words of a window; a shorter item is one window as a whole.
SPAN = 13
#: Words of a k-gram.  SPAN - GRAM + 1 k-grams are one winnowing window.
GRAM = 4
#: A list of up to so many candidate documents is broadcast to where the texts are read;
#: beyond it the texts are shuffled to a sort-merge join.
CANDIDATE_ROWS = 100_000
NOT_WORDS = r"[\x00-\x2F:-`{-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, NOT_WORDS), "")


def document_key(doc_id: Column, text: Column) -> Column:
    """(id, digest of the text): tells rows of one id with different texts apart."""
    return F.struct(doc_id.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"))


def _with_grams(df: DataFrame, words: str, n: int) -> DataFrame:
    """Adds ``_g``: the hash of the n words from each position on.  Where fewer
    than n words follow, the hash is of those that do.

    The arrays are declared not null, and exploded with the outer forms: else the
    optimizer derives filters (not null, not empty) from later steps, pushes them
    below these projections and so writes whole projections into the lambdas,
    which would evaluate them for every element.
    """

    def gram(first, at):
        return F.xxhash64(first, *[F.get("_h", at + j) for j in range(1, n)])

    present = F.coalesce(words, F.array().cast("array<string>"))
    hashed = df.withColumn("_h", F.transform(present, lambda w: F.xxhash64(w)))
    return hashed.withColumn("_g", F.transform("_h", gram)).drop("_h")


def _whole(column: str, words: str, n: int) -> Column:
    """The elements of positions that n words follow, the own one included."""
    return F.slice(F.col(column), 1, F.greatest(F.size(words) - n + 1, F.lit(0)))


def fingerprints(df: DataFrame, words: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Adds ``fp``: the distinct minima over every window of span - gram + 1
    k-grams.  Texts of fewer than ``span`` words have none."""
    out, width = _with_grams(df, words, gram), 1
    # minima over 2, 4, 8... and at last over the whole window, by doubling
    while width < span - gram + 1:
        step = min(width, span - gram + 1 - width)
        out = out.withColumn("_g", F.transform("_g", _least_with(step)))
        width += step
    return out.withColumn("fp", F.array_distinct(_whole("_g", words, span))).drop("_g")


def _least_with(step: int):
    return lambda x, i: F.least(x, F.get("_g", i + step))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Hit words and items of the documents that share a window with the benchmark.

    Returns two frames: (doc key, n_hit) and (doc key, item), with one row per
    affected document and one per document and item.  A document key is the
    struct (id, digest of the text), so that repeated rows are examined once and
    rows with one id and different texts apart.  Items and documents without words
    match nothing, null ids are keys like others, items with the same text all
    count.  Items shorter than ``span`` words are one window, found by hashing
    exactly as many words of every document; that pass only runs for the short
    lengths that occur (at most span - 1).  The lists collected per document are
    bounded by its own words.
    """
    key = document_key(F.col(id_col), F.col(text_col))
    docs = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("item_words"))
    items = settled(items.filter(F.size("item_words") > 0).distinct(), "decontaminate-items")

    # fingerprints the documents share with the benchmark
    long_items = fingerprints(items.filter(F.size("item_words") >= span), "item_words", span, gram)
    marks = settled(
        _with_grams(long_items, "item_words", gram)
        .select("item", F.posexplode_outer(_whole("_g", "item_words", gram)).alias("pos", "g"), "fp")
        .filter(F.array_contains(F.coalesce("fp", F.array().cast("array<long>")), F.col("g")))
        .select("item", "pos", F.col("g").alias("fp")),
        "decontaminate-marks",
    )
    worded = docs.select("key", words_of(F.col("_t")).alias("words"))
    shared = (
        fingerprints(worded.filter(F.size("words") >= span), "words", span, gram)
        .select("key", F.explode_outer("fp").alias("fp"))
        .join(marks.select("fp").distinct(), "fp")
        .groupBy("key")
        .agg(F.collect_set("fp").alias("fps"))
    )
    shared = settled(shared, "decontaminate-shared")

    # where they lie in the document, and so how document and item align
    texts = docs.join(checked(shared, CANDIDATE_ROWS), "key").dropDuplicates(["key"])
    texts = settled(texts.select("key", "fps", words_of(F.col("_t")).alias("words")), "decontaminate-texts")
    spots = _with_grams(texts, "words", gram)
    spots = spots.select("key", "fps", F.posexplode_outer(_whole("_g", "words", gram)).alias("at", "g"))
    spots = spots.filter(F.array_contains("fps", F.col("g"))).select("key", "at", F.col("g").alias("fp"))
    aligned = spots.join(marks, "fp").select("key", "item", (F.col("at") - F.col("pos")).alias("shift"))
    lengths = [r["n"] for r in items.select(F.size("item_words").alias("n")).filter(F.col("n") < span).distinct().collect()]
    for n in sorted(lengths):
        short = items.filter(F.size("item_words") == n)
        whole = _with_grams(short, "item_words", n).select("item", F.get("_g", F.lit(0)).alias("fp"))
        grams = _with_grams(worded.filter(F.size("words") >= n), "words", n)
        grams = grams.select("key", F.posexplode_outer(_whole("_g", "words", n)).alias("at", "fp"))
        aligned = aligned.unionAll(grams.join(whole, "fp").select("key", "item", F.col("at").alias("shift")))
    aligned = aligned.distinct()
    if lengths:
        aligned = settled(aligned, "decontaminate-alignments")
        texts = docs.join(aligned.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        texts = texts.select("key", words_of(F.col("_t")).alias("words"))

    # extend every hit: compare the words along the alignment
    by_key = aligned.join(items.select("item", F.size("item_words").alias("size")), "item")
    by_key = by_key.groupBy("key").agg(F.collect_list(F.struct("item", "shift", "size")).alias("a"))
    beside = texts.join(by_key, "key").select("key", "words", F.explode("a").alias("a"))
    skip = F.greatest(-F.col("a.shift"), F.lit(0))
    beside = beside.select(
        "key",
        F.col("a.item").alias("item"),
        F.col("a.shift").alias("shift"),
        skip.alias("skip"),
        F.slice("words", F.col("a.shift") + skip + 1, F.col("a.size") - skip).alias("piece"),
    ).join(items, "item")
    n = F.least(F.size("item_words"), F.lit(span))
    last = F.size("piece") - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(
        starts,
        lambda p: F.slice("piece", p + 1, F.col("n")) == F.slice("item_words", p + F.col("skip") + 1, F.col("n")),
    )
    hits = beside.withColumn("n", n).select(
        "key", "item", "n", F.explode(equal).alias("p"), (F.col("shift") + F.col("skip")).alias("base")
    )
    hits = settled(hits.select("key", "item", (F.col("base") + F.col("p")).alias("at"), "n"), "decontaminate-hits")
    ends = hits.groupBy("key", "at").agg(F.max("n").alias("n")).groupBy("key")
    spans = ends.agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("s"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))

    def cover(done, x):
        end = x["at"] + x["n"]
        more = F.greatest(end - F.greatest(done["to"], x["at"]), F.lit(0))
        return F.struct(F.greatest(done["to"], end).alias("to"), (done["n"] + more).alias("n"))

    n_hit = F.aggregate("s", start, cover, lambda done: done["n"].cast("long"))
    return spans.select("key", n_hit.alias("n_hit")), hits.select("key", "item").distinct()
