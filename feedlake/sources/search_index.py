"""A stored positional index: searches read postings, never texts.

Documents (items, details, feeds) are cut into blocks of consecutive ids.  A
posting is one row per (kind, token, block) with the places of its documents in
the block, and the sorted codes of all its occurrences, a code being the place
times 2^32 plus the position.  Codes grow slowly, so the files store them as
deltas; they are read only for words of phrases.  Words of a
phrase are codes that follow each other.

Every word and phrase of the searches becomes one bitmap per block, whatever number
of searches use it, so words together, ``or`` and minus are bitwise operations.  Of
all blocks' rows the lists are moved once.  A block's bitmaps make one row, found by the
numbers of the words; the searches, as numbers, are dealt to every group of blocks and
pass by its rows, so that neither the driver nor a task holds them all.  One search and a
table of searches take the same way.  Every batch of documents is a folder of its own, so
a batch can be repeated; postings of one block may lie in several of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions import matching
from feedlake.functions.links import full_host
from feedlake.session import settled

#: Consecutive ids of one block: what a task holds of a word at a time.
BLOCK_IDS = 256
#: Searches with up to so many different words push them down to the files.
PUSHED_WORDS = 64
#: Up to so many words of searches are broadcast.
WORD_ROWS = 200_000
#: Blocks that a task holds on average at most.
TASK_BLOCKS = 64
#: Searches times blocks beyond which a task's are dealt to more tasks, up to four per core:
#: every group of blocks is another copy of the searches.
TASK_PAIRS = 1_000_000
TASKS_PER_CORE = 4
#: Different searches, and askers of one search, that pass by the blocks together: a block's
#: bitmaps are copied for each chunk of searches, not for each search.
CHUNK = 500
ASKERS = 500
#: In every document, at position 0.
EVERYWHERE = ""
_BREAK = "\n"

ITEM, DETAIL, FEED = "item", "detail", "feed"

POSTING = "kind string, token string, block long, codes array<long>, places array<int>"


def _sequence(parts: list[Column], url: Column | None) -> Column:
    """Tokens of a document at their positions; the host stands apart, so that no
    phrase runs into it."""
    found = F.concat(F.array(F.lit(EVERYWHERE)), matching.words(parts, url))
    if url is None:
        return found
    host = full_host(F.coalesce(url, F.lit("")))
    return F.concat(found, F.array(F.lit(_BREAK), F.when(host != "", host).otherwise(F.lit(_BREAK))))


def _lists(rows: DataFrame, kind: str, id_col: str, parts: list[str], url: str | None) -> DataFrame:
    """(kind, token, block, codes) of the words of texts.  Texts are dealt out by block,
    so that lists need not be moved: they take several times the room of the texts."""
    place = F.pmod(F.col(id_col), F.lit(BLOCK_IDS).cast("long"))
    wanted = [(F.col(id_col) - place).alias("block"), place.alias("place"), *parts, *([url] if url else [])]
    texts = rows.filter(F.col(id_col).isNotNull()).select(*wanted).repartition("block")
    tokens = _sequence([F.col(p) for p in parts], F.col(url) if url else None)
    each = texts.select("block", "place", F.posexplode_outer(tokens).alias("pos", "token")).filter(F.col("token") != _BREAK)
    code = F.shiftleft("place", 32) + F.col("pos")
    lists = each.select("token", "block", code.alias("code")).groupBy("token", "block").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return lists.select(F.lit(kind).alias("kind"), "token", "block", "codes")


def alternatives(text: Column) -> Column:
    """A search text as an array of alternatives, each an array of terms
    ``(negated, words)``: the grammar of :func:`matching.query_terms` as a column."""
    query = F.lower(F.coalesce(text, F.lit("")))
    minus, quoted, bare = (F.regexp_extract_all(query, F.lit(matching.PIECE), F.lit(g)) for g in (1, 2, 3))

    def coded(piece: Column) -> Column:
        phrase = F.regexp_extract_all(F.when(piece["q"] != "", piece["q"]).otherwise(piece["w"]), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
        sign = F.when((piece["m"] != "") | F.startswith(piece["w"], F.lit("-")), F.lit("-")).otherwise(F.lit("+"))
        return F.when(piece["w"] == "or", F.lit("\x01")).otherwise(F.concat(sign, F.array_join(phrase, " ")))

    pieces = F.arrays_zip(minus.alias("m"), quoted.alias("q"), bare.alias("w"))
    # signs that no word holds part the alternatives and their terms
    joined = F.array_join(F.transform(pieces, coded), "\x02")

    def terms(alternative: Column) -> Column:
        full = F.filter(F.split(alternative, "\x02"), lambda t: F.length(t) > 1)
        return F.transform(full, lambda t: F.struct(F.startswith(t, F.lit("-")).alias("negated"), F.split(F.substring(t, 2, 1 << 30), " ").alias("words")))

    return F.filter(F.transform(F.split(joined, "\x01"), terms), lambda a: F.size(a) > 0)


def _bitmap(rows: DataFrame, *key: str) -> DataFrame:
    """The places of every key's rows as a bitmap of a block, 64 ids to a column."""
    bit = F.expr("shiftleft(1L, place % 64)")
    return rows.groupBy(*key).agg(*[F.bit_or(F.when(F.floor(F.col("place") / 64) == i, bit).otherwise(0)).alias(b) for i, b in enumerate(_bits())])


def _bits() -> list[str]:
    return [f"bits{i}" for i in range(-(-BLOCK_IDS // 64))]


def _tables(bitmaps: DataFrame) -> DataFrame:
    """(kind, block, words): all bitmaps of a block in one row.  Entry ``code / 64`` of
    ``words`` holds which of its 64 codes the block knows, and then their bitmaps in order."""
    key = ["kind", "block", "word"]
    known = bitmaps.select("kind", "block", F.shiftright("code", 6).alias("word"), F.expr("code & 63").alias("bit"), F.array(*_bits()).alias("bits"))
    held = known.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"), F.sort_array(F.collect_list(F.struct("bit", "bits"))).alias("bits"))
    held = held.select(*key, F.concat(F.array("mask"), F.flatten("bits.bits")).alias("held"))
    listed = held.groupBy("kind", "block").agg(F.sort_array(F.collect_list(F.struct("word", "held"))).alias("listed"))

    def after_gap(x: Column, i: Column) -> Column:
        gap = x["word"] - F.coalesce(F.get("listed", i - 1)["word"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(None).cast("array<long>"), gap), F.array(x["held"]))

    return listed.select("kind", "block", F.flatten(F.transform("listed", after_gap)).alias("words"))


def _satisfying(met: DataFrame) -> DataFrame:
    """(query_id, kind, id) of ``met(asked, kind, block, words)``."""
    none, all_ids = F.lit(0).cast("long"), F.lit(-1).cast("long")

    def mask(code: Column) -> Column:
        return F.get(F.get("words", F.shiftright(code, 6)), F.lit(0))

    def shifted(bits: Column, code: Column) -> Column:
        return F.call_function("shiftleft", bits, code.bitwiseAND(63))

    def known(code: Column) -> Column:
        return F.coalesce(mask(code).bitwiseAND(shifted(F.lit(1).cast("long"), code)) != 0, F.lit(False))

    def bits(code: Column) -> Column:
        before = F.bit_count(mask(code).bitwiseAND(F.bitwise_not(shifted(all_ids, code))))
        return F.slice(F.get("words", F.shiftright(code, 6)), before * len(_bits()) + 2, F.lit(len(_bits())))

    def all_known(a: Column) -> Column:
        return F.forall(a["present"], known)

    def held(a: Column) -> Column:
        absent = F.transform(F.filter(a["absent"], known), bits)
        return F.struct(F.transform(a["present"], bits).alias("present"), absent.alias("absent"))

    def found(alternatives: Column, i: int) -> Column:
        def of(a: Column) -> Column:
            every = F.aggregate(a["present"], all_ids, lambda x, b: x.bitwiseAND(F.get(b, F.lit(i))))
            some = F.aggregate(a["absent"], none, lambda x, b: x.bitwiseOR(F.get(b, F.lit(i))))
            return every.bitwiseAND(F.bitwise_not(some))

        return F.aggregate(alternatives, none, lambda x, a: x.bitwiseOR(of(a)))

    def looked_up(s: Column) -> Column:
        held_there = F.transform(F.filter(s["alternatives"], all_known), held)
        return F.struct(s["query_ids"].alias("query_ids"), held_there.alias("held"))

    def hits_of(s: Column) -> Column:
        return F.struct(s["query_ids"].alias("query_ids"), *[found(s["held"], i).alias(b) for i, b in enumerate(_bits())])

    known_to = F.filter(F.transform("asked", looked_up), lambda s: F.size(s["held"]) > 0)
    hit = met.select("kind", "block", F.inline(F.transform(known_to, hits_of)))
    words = F.array(*[F.struct(F.lit(i * 64).alias("at"), F.col(b).alias("bits")) for i, b in enumerate(_bits())])
    full = hit.select("query_ids", "kind", "block", F.inline(words)).filter("bits <> 0")
    ids = full.select("*", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("bit")).filter("(shiftright(bits, bit) & 1L) = 1L")
    ids = ids.select("query_ids", "kind", (F.col("block") + F.col("at") + F.col("bit")).alias("id"))
    return ids.select(F.explode("query_ids").alias("query_id"), "kind", "id")


class SearchIndex:
    """Postings of all documents below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def add(self, items: DataFrame | None, details: DataFrame | None, feeds: DataFrame | None, batch: int = 0) -> None:
        """Index a batch of new documents; repeating it replaces its own postings.

        Every document is added once: a changed text is a new document of a new
        index, or of one built again.  Null texts are empty, rows without an id
        are left out.
        """
        parts = []
        if items is not None:
            parts.append(_lists(items, ITEM, "id", ["title"], "url"))
        if details is not None:
            parts.append(_lists(details, DETAIL, "feed_item_id", ["summary", "content", "author"], None))
        if feeds is not None:
            parts.append(_lists(feeds, FEED, "id", ["title"], "url"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        places = F.array_distinct(F.transform("codes", lambda c: F.shiftright(c, 32).cast("int")))
        ordered = rows.withColumn("places", places).sortWithinPartitions("kind", "token", "block")
        path = f"{self.root}/postings/batch_id={batch}"
        # version 2 pages: longs as deltas, if no dictionary takes their place
        writer = ordered.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0")
        writer.option("parquet.enable.dictionary#codes.list.element", "false").parquet(path)
        counts = self.spark.read.schema(POSTING).parquet(path).groupBy("kind", "token").agg(F.sum(F.size("places")).alias("n_docs"))
        counts.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.root}/dictionary/batch_id={batch}")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(f"{self.root}/postings").select(*POSTING.replace(",", "").split()[::2])

    def dictionary(self) -> DataFrame:
        """(kind, token, n_docs) of each batch."""
        return self.spark.read.schema("kind string, token string, n_docs long").parquet(f"{self.root}/dictionary").select("kind", "token", "n_docs")

    def hits(self, queries: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """(query_id, kind, id) of all documents that satisfy ``queries(query_id, text)``.

        Bare words must all be in a document, quotes make a phrase, ``or`` parts
        alternatives, a leading minus excludes; a compound is the phrase of its
        parts.  A null or empty text, or one without words, finds nothing; nor does an
        alternative of an id that another row of this id has at the same place.
        """
        of_kind = F.col("kind").isin(kinds or [ITEM, DETAIL, FEED])

        def terms_of(terms: str, negated: bool) -> Column:
            of_sign = F.filter(terms, lambda t: t["negated"] == negated)
            return F.array_distinct(F.transform(of_sign, lambda t: F.array_join(t["words"], " ")))

        asked = queries.filter(F.col("query_id").isNotNull()).select("query_id", F.posexplode(alternatives(F.col("text"))).alias("alt", "terms"))
        # an alternative of exclusions alone starts from all documents
        present = terms_of("terms", False)
        present = F.when(F.size(present) > 0, present).otherwise(F.array(F.lit(EVERYWHERE)))
        alternative = F.struct(F.array_sort(present).alias("present"), F.array_sort(terms_of("terms", True)).alias("absent"))
        alone = asked.groupBy("query_id", "alt").agg(F.first(alternative).alias("alternative"), F.count(F.lit(1)).alias("rows")).filter("rows = 1")
        asked = alone.groupBy("query_id").agg(F.sort_array(F.collect_set("alternative")).alias("alternatives"))
        asked = settled(asked, "search-alternatives")
        # equal searches are evaluated once
        searches = asked.groupBy("alternatives").agg(F.count(F.lit(1)).alias("askers"))
        searches = settled(searches.withColumn("search", F.monotonically_increasing_id()), "searches")
        each = searches.select("search", F.posexplode("alternatives").alias("alt", "a"))
        signed = F.concat(
            F.transform("a.present", lambda t: F.struct(t.alias("term"), F.lit(False).alias("negated"))),
            F.transform("a.absent", lambda t: F.struct(t.alias("term"), F.lit(True).alias("negated"))),
        )
        needed = settled(each.select("search", "alt", F.inline(signed)), "search-terms")
        terms = self._numbered(needed.select("term").distinct(), of_kind)

        n_blocks = self.postings().filter(of_kind & (F.col("token") == EVERYWHERE)).select("kind", "block").distinct().count()
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(cores, -(-n_blocks // TASK_BLOCKS), min(TASKS_PER_CORE * cores, -(-n_blocks * searches.count() // TASK_PAIRS)))
        tasks = max(1, min(n_blocks, tasks))
        blocks = settled(_tables(self._bitmaps(terms, of_kind, tasks)), "search-bitmaps")
        coded = settled(self._coded(needed, terms, asked, searches), "search-codes")

        # the searches meet a group of blocks where the blocks are
        blocks = blocks.withColumn("cell", F.pmod(F.hash("kind", "block"), F.lit(tasks))).repartition(tasks, "cell")
        dealt = coded.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "cell")
        return _satisfying(dealt.join(blocks.hint("shuffle_hash"), "cell"))

    def _numbered(self, terms: DataFrame, of_kind: Column) -> DataFrame:
        """(term, code) of words and phrases: nearly dense, the higher the rarer.  Phrases,
        which no dictionary counts, are taken for rare."""
        counts = self.dictionary().filter(of_kind).groupBy(F.col("token").alias("term")).agg(F.sum("n_docs").alias("n"))
        # the 64 terms of a word of codes are of 64 parts, numbered on their own
        part = F.pmod(F.xxhash64("term"), F.lit(64)).cast("int")
        row = F.row_number().over(Window.partitionBy("part").orderBy(F.coalesce("n", F.lit(0)).desc(), "term"))
        parted = terms.join(counts, "term", "left").withColumn("part", part)
        return settled(parted.select("term", ((row - 1) * 64 + F.col("part")).alias("code")), "search-words")

    @staticmethod
    def _coded(needed: DataFrame, terms: DataFrame, asked: DataFrame, searches: DataFrame) -> DataFrame:
        """(asked): about ``CHUNK`` searches by the codes of their terms, the rarest first, with
        about ``ASKERS`` of those that ask them, the rest of these in other rows."""
        of_sign = [F.sort_array(F.collect_list(F.when(F.col("negated") == n, F.col("code"))), asc=False).alias(c) for c, n in (("present", False), ("absent", True))]
        each = needed.join(terms, "term").groupBy("search", "alt").agg(*of_sign)
        coded = each.groupBy("search").agg(F.collect_list(F.struct("present", "absent")).alias("alternatives"))
        share = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("askers") / ASKERS))
        owners = asked.join(searches, "alternatives").groupBy("search", share.alias("share")).agg(F.collect_list("query_id").alias("query_ids"))
        chunk = F.pmod(F.xxhash64("search"), F.lit(max(1, -(-searches.count() // CHUNK))))
        return coded.join(owners, "search").groupBy(chunk.alias("chunk"), "share").agg(F.collect_list(F.struct("alternatives", "query_ids")).alias("asked")).select("asked")

    def _bitmaps(self, terms: DataFrame, of_kind: Column, tasks: int) -> DataFrame:
        """(kind, block, code, bits) of ``terms(term, code)``, words and phrases, the words of a
        phrase joined by blanks.  Phrases are found by pairs of words at consecutive places."""
        words = F.split("term", " ")
        alone = F.size(words) == 1
        tokens = terms.filter(alone).select(F.col("term").alias("token"), "code", F.lit(False).alias("phrased")).unionByName(
            terms.filter(~alone).select(F.explode(words).alias("token")).distinct().select("token", F.lit(None).cast("int").alias("code"), F.lit(True).alias("phrased"))
        )
        tokens = settled(tokens, "search-tokens")
        few = [r["token"] for r in tokens.select("token").distinct().limit(PUSHED_WORDS + 1).collect()]
        small = tokens.limit(WORD_ROWS + 1).count() <= WORD_ROWS

        def lists(phrased: bool, *columns: str) -> DataFrame:
            wanted = tokens.filter(F.col("phrased") == phrased).select("token", F.col("code").alias("term"))
            pushed = of_kind & F.col("token").isin(few) if len(few) <= PUSHED_WORDS else of_kind
            met = self.postings().filter(pushed).join(F.broadcast(wanted) if small else wanted, "token")
            return met.select("kind", "block", *columns).repartition(tasks, "kind", "block")

        places = lists(False, "term", "places").select("kind", "block", F.col("term").alias("code"), F.explode("places").alias("place"))
        single = _bitmap(places, "kind", "block", "code")

        pair = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(i.alias("offset"), F.get("w", i).alias("token"), F.get("w", i + 1).alias("next")))
        pairs = terms.select(F.col("code").alias("term"), words.alias("w")).filter(F.size("w") > 1).select("term", (F.size("w") - 1).alias("pairs"), F.inline(pair))
        pairs = settled(pairs, "search-pairs")
        codes = lists(True, "token", "codes").select("kind", "block", "token", F.explode("codes").alias("code"))
        beside = Window.partitionBy("kind", "block").orderBy("code").rangeBetween(1, 1)
        nexts = codes.withColumn("next", F.collect_set("token").over(beside)).withColumn("next", F.explode("next"))
        few_pairs = pairs.limit(WORD_ROWS + 1).count() <= WORD_ROWS
        at = nexts.join(F.broadcast(pairs) if few_pairs else pairs, ["token", "next"])
        start = ["kind", "block", "term", "pairs", "start"]
        at = at.withColumn("start", F.col("code") - F.col("offset")).select(*start, "offset").distinct()
        whole = at.groupBy(*start).agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") == F.col("pairs"))
        whole = whole.select("kind", "block", F.col("term").alias("code"), F.shiftright("start", 32).cast("int").alias("place"))
        return single.unionByName(_bitmap(whole, "kind", "block", "code"))

    def hits_of(self, query: str) -> DataFrame:
        """(kind, id) of all documents that satisfy one search."""
        return self.hits(self.spark.createDataFrame([(0, query)], "query_id long, text string")).select("kind", "id")


__all__ = ["DETAIL", "FEED", "ITEM", "SearchIndex", "alternatives"]
