"""Mixing sources to target weights by Pareto order sampling.

Every source has a target of words.  With r = target / size of the source each
of its documents is expected r times in the mix: floor(r) copies are certain, and
the rest is its inclusion probability p in a sample without replacement.  Pareto
order sampling ranks documents by the random odds u / (1 - u) divided by the
inclusion odds p / (1 - p) and takes the first of them, as many as the words
that the certain copies left open; ``appeal`` makes p unequal within a source.

Only DataFrame functions are used.  A source may hold a third of all rows, so
no window spans one: rows are dealt by ranges of (source, rank value), sums of
the ranges are added up, and running totals are taken inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import checked, partitions_for, settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: No source, and no document, is repeated more often.
MOST_COPIES = 3
#: Rows of one range.
RANGE_ROWS = 1 << 20
#: A table of up to so many sources is broadcast to the documents.
SOURCE_ROWS = 200_000
#: Equal rows that one task writes out at a time.
EQUAL_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` (a unique one) with their range as
    ``_range``, written out so that the ranges stay as they are."""
    n = partitions_for(rows.sparkSession, rows.count(), RANGE_ROWS)
    return settled(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name)


def running(rows: DataFrame, order: list[Column], within: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of one ``within`` that come before, for rows
    that :func:`placed` has dealt by (within, order)."""
    keyed = rows.withColumn("_value", value)
    sums = keyed.groupBy(*within, "_range").agg(F.sum("_value").alias("_sum"))
    front = (Window.unboundedPreceding, -1)
    # a row per range and key, most keys lying in one range
    across = Window.partitionBy(*(F.col(c) for c in within)).orderBy("_range").rowsBetween(*front)
    zero = F.lit(0).cast("long")
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(across), zero)).drop("_sum")
    inside = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(*front)
    ranked = keyed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), zero))
    joined = ranked.join(starts, [*within, "_range"])
    return joined.withColumn(out, F.col("_start") + F.col("_inside")).drop("_value", "_inside", "_start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_no, source_size, target) for rows (source, source_size).

    Sources weigh ``weights`` in turn, by code point, null last, and share the sum
    of all sizes; none is given more than ``most`` times its size, and what it
    can't take is shared among the others by weight, until none is above.
    """
    order = [F.asc_nulls_last("source")]
    # a null's place is last; ranges are dealt by a key without nulls
    keyed = sizes.withColumn("_null", F.col("source").isNull())
    ranged = placed(keyed, [F.col("_null"), *order], "mix-sources").withColumn("_all", F.lit(0))
    numbered = running(ranged, [F.col("_null"), *order], ["_all"], F.lit(1).cast("long"), "source_no")
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod("source_no", F.lit(len(weights))).cast("int")]
    rows = numbered.select("source", "source_no", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    rows = settled(rows, "mix-weights")
    total, share = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    full, left, open_share = -1, total, share
    while open_share:
        level = left / open_share
        over = rows.filter(F.col("cap") <= F.col("w") * F.lit(level))
        n, cap, w = over.agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == full:
            break
        full, left, open_share = n, total - cap, share - w
    most_words = F.col("cap").cast("double")
    target = F.least(most_words, F.col("w") * F.lit(float(level))) if open_share else most_words
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    appeal: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "",
) -> DataFrame:
    """One row per document: (doc_id, digest, source, size, source_size, target, copies).

    ``copies`` times a document's words are what the mix takes of it, never more
    than ``most``.  A document's random number is the md5 of its id and text, so
    reruns and other partitionings agree; with ``seed`` another sample is drawn.
    Of every source the longest run of the Pareto order that fits the open words
    is taken, and then the one document whose size comes nearest to what is still
    missing, if that is nearer than none.  ``appeal`` (a positive number; null or
    not above 0 counts as 1) makes documents more likely within their source.

    Null and empty texts have size 0; the mix may repeat them but takes nothing.
    A source without words has target 0; null is a source of its own.  Rows alike
    in id, source and text are interchangeable and may differ by one copy; rows
    without an id take part.  An empty table has no rows.
    """
    liking = F.lit(1.0) if appeal is None else F.when(appeal > 0, appeal.cast("double")).otherwise(F.lit(1.0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.md5(text).alias("digest"), liking.alias("liking")
    )
    # equal rows are one from here on; they are combined before the shuffle
    alike = rows.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("m"), F.max("liking").alias("liking"))
    alike = settled(alike, "mix-documents")
    sizes = alike.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.col("size") * F.col("m") * F.col("liking")).alias("liked")
    )
    sizes = settled(sizes, "mix-sizes")
    goals = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    liked = sizes.select(F.col("source").alias("_liked"), "liked")
    goals = settled(goals.join(liked, F.col("_source").eqNullSafe(F.col("_liked"))).drop("_liked"), "mix-targets")
    known = alike.join(checked(goals, SOURCE_ROWS), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # words the source would get at an appeal of 1
    rate = F.when(F.col("liked") > 0, F.col("target") / F.col("liked")).otherwise(F.lit(0.0))
    expected = F.least(rate * F.col("liking"), F.lit(float(most)))
    number = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest")))
    u = (F.conv(F.substring(number, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.col("expected") - F.col("certain")
    inclusion = F.when(p > 0, (F.lit(1.0) - p) / p).otherwise(F.lit(float("inf")))
    drawn = known.withColumns({"expected": expected, "number": number, "u": u}).withColumn("certain", F.floor("expected"))
    drawn = drawn.withColumn("q", (F.col("u") / (F.lit(1.0) - F.col("u"))) * inclusion).drop("expected", "u", "liking", "liked")
    sure = drawn.groupBy("source_no").agg(F.sum(F.col("certain") * F.col("size") * F.col("m")).alias("sure"))
    order = [F.col("q"), F.col("number")]
    ranged = placed(drawn, [F.col("source_no"), *order], "mix-ranked")
    before = running(ranged, order, ["source_no"], F.col("size") * F.col("m"), "before")
    sure = checked(settled(sure, "mix-certain"), SOURCE_ROWS)
    space = F.floor((F.col("target") - F.col("sure") - F.col("before")) / F.col("size"))
    able = (F.col("size") > 0) & (F.col("certain") < most)
    taken = F.when(able, F.greatest(F.lit(0), F.least(space, F.col("m")))).otherwise(F.lit(0)).cast("long")
    first = settled(before.join(sure, "source_no").withColumn("extra", taken), "mix-first")

    # one document more per source, where its size comes nearest to what is missing
    used = first.groupBy("source_no").agg(F.sum(F.col("extra") * F.col("size")).alias("used"))
    gaps = first.select("source_no", (F.col("target") - F.col("sure")).alias("open")).distinct().join(used, "source_no")
    gaps = checked(settled(gaps.select("source_no", (F.col("open") - F.col("used")).alias("gap")), "mix-gaps"), SOURCE_ROWS)
    off = F.abs(F.col("size") - F.col("gap"))
    spare = first.filter(able & (F.col("extra") < F.col("m"))).join(gaps, "source_no").filter(off < F.col("gap"))
    last = spare.groupBy("source_no").agg(F.min(F.struct(off.alias("off"), F.col("q"), F.col("number"))).alias("last"))
    last = checked(settled(last.select(F.col("source_no").alias("_no"), F.col("last.number").alias("_number")), "mix-last"), SOURCE_ROWS)
    hit = (F.col("source_no") == F.col("_no")) & (F.col("number") == F.col("_number"))
    whole = first.join(last, hit, "left").withColumn("extra", F.col("extra") + F.when(F.col("_no").isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    return _single_rows(whole).select("doc_id", "digest", "source", "size", "source_size", "target", "copies")


def _single_rows(rows: DataFrame) -> DataFrame:
    """Groups of ``m`` equal rows as single ones, ``extra`` of them with a copy
    more; a large group is cut into pieces that are dealt out first."""
    kinds = F.array(
        F.struct(F.col("extra").alias("n"), (F.col("certain") + 1).alias("copies")),
        F.struct((F.col("m") - F.col("extra")).alias("n"), F.col("certain").alias("copies")),
    )
    each = rows.withColumn("_kind", F.explode(F.filter(kinds, lambda k: k["n"] > 0)))
    each = each.withColumn("copies", F.col("_kind.copies")).withColumn("_n", F.col("_kind.n")).drop("_kind", "extra")
    few = each.filter(F.col("_n") <= EQUAL_ROWS)
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / EQUAL_ROWS)))
    many = each.filter(F.col("_n") > EQUAL_ROWS).withColumn("_piece", pieces)
    many = many.withColumn("_n", F.least(F.lit(EQUAL_ROWS).cast("long"), F.col("_n") - F.col("_piece") * EQUAL_ROWS))
    many = many.repartition("number", "_piece").drop("_piece")
    return few.unionByName(many).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_i", "_n")


def mixed_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself: (doc_id, source, text), a row per copy that
    ``mix`` (a :func:`mixture` of ``docs``) takes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.md5(text).alias("_digest"), text.alias("text"))
    copies = mix.groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("copies"))
    one = texts.groupBy("_id", "_source", "_digest").agg(F.first("text").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("digest") == F.col("_digest"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return copies.filter("copies > 0").join(one, same).select("doc_id", "source", "text", each.alias("_copy")).drop("_copy")
