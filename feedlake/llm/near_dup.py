"""Near-duplicate documents by HyperMinHash.

Every distinct shingle set gets one register per bucket.  A bucket permutes the
shingles' hashes in its own way and keeps, of the smallest, the number of
leading zeros and a few bits after the first one (mantissa).  Bands of registers
propose candidates, an estimate from all registers, corrected for registers that
agree by chance, discards the hopeless, and the full sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import (
    arrow_rows,
    checked,
    components,
    discard,
    forget_shuffles,
    hand_back,
    new_folder,
    partitions_for,
    settled,
    settled_at,
)

SHINGLE_WORDS = 2
#: Sets are linked from this similarity on, in percent.
PERCENT = 80
BUCKETS = 252
#: Registers of a band: a pair at the threshold misses all 42 bands with
#: probability (1 - 0.8^6)^42 < 3e-6.
BAND = 6
MANTISSA_BITS = 10
#: Estimates this far below the threshold are discarded: over four standard
#: errors of 252 registers (0.025 at 0.8).
MARGIN = 0.11
#: Members of a band that one task compares at a time.
BLOCK = 1024
#: Blocks that either side of a band is split into at most: beyond, blocks grow, so that
#: a member is sent to a bounded number of tasks, however many the band has.
MOST_BLOCKS = 4
#: Members of bands that are dealt out at a time, so that only a few of the bands lie
#: on the disks; of many sets one band at a time.
ROUND_MEMBERS = 2_000_000
#: The number of a band is the upper bits of its key.
BAND_BITS = 6

#: Rows that bands of one block share a group of, so that few are called for.
BUNDLE = 8192
#: Sets of up to so many shingles (16 KB) travel with their sketches and are
#: compared in full beside them; a pair with a larger one is joined to its sets.
HELD = 2048
#: Words whose hashes a task remembers (about 30 MB).
KNOWN_WORDS = 200_000
#: Sketches of latest sets that a worker remembers for their copies (10 MB).
REMEMBERED = 20_000

#: A list of up to so many documents is broadcast to where texts are read.
WANTED_ROWS = 500_000

USABLE = "id is not null and n_shingles > 0"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scatter(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` remembers those of earlier texts."""
    import xxhash

    missing = [w for w in words if w not in known]
    for w in missing:
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of fewer words the
    whole sequence is the only shingle, of none there is none."""
    if not len(words):
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    out = np.full(count, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = _scatter(out * _MIX + words[i : i + count])
    return np.unique(out)


def registers(shingles: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """One 16-bit register per bucket: leading zeros (6 bits) and mantissa (10).

    A bucket's permutation multiplies the upper halves of the shingles' hashes,
    which are random already, by its own odd factor."""
    factors = _factors(buckets)
    values = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(buckets, np.iinfo(np.uint32).max, dtype=np.uint32)
    part = np.empty((256, buckets), dtype=np.uint32)
    for at in range(0, len(values), 256):
        own = values[at : at + 256]
        np.multiply(own, factors, out=part[: len(own)])
        np.minimum(low, part[: len(own)].min(axis=0), out=low)
    # leading zeros by the exponent of the float; the mantissa follows the first one
    low = np.maximum(low, np.uint32(1 << MANTISSA_BITS))
    top = np.frexp(low.astype(np.float64))[1] - 1
    mantissa = (low >> (top - MANTISSA_BITS).astype(np.uint32)) & np.uint32((1 << MANTISSA_BITS) - 1)
    return ((31 - top).astype(np.uint32) << np.uint32(MANTISSA_BITS) | mantissa).astype("<u2")


@lru_cache(maxsize=8)
def _factors(buckets: int) -> np.ndarray:
    seeds = _scatter(np.arange(1, buckets + 1, dtype=np.uint64) * _MIX)
    return (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from equal registers.  Two unrelated registers agree by chance
    with probability c = 1/3 (equal leading zeros) / 2^bits; equal ones are
    J + (1 - J) c of all."""
    chance = 1 / 3 / (1 << MANTISSA_BITS)
    equal = (a == b).mean(axis=-1)
    return np.maximum((equal - chance) / (1 - chance), 0.0)


def shingled(docs: DataFrame, size: int, id_col: str, text_col: str, full: bool = False) -> DataFrame:
    """(id, n_shingles, digest, sig): size, digest and registers of each set; with
    ``full`` (id, digest, shingles), the set itself as sorted 64-bit hashes."""
    import hashlib

    shape = "digest binary, shingles binary" if full else "n_shingles long, digest binary, sig binary"

    # a scalar function leaves ids in the JVM: beside a null pandas would make them doubles
    @F.pandas_udf(shape)
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        sketched: dict[bytes, bytes] = {}
        try:
            for texts in batches:
                rows = []
                for text in texts:
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    if len(sketched) > REMEMBERED:
                        sketched.clear()
                    # bytes know only ASCII letters and white space, as asked
                    words = text.encode("utf-8", "replace").lower().split()
                    found = shingle_set(word_hashes(words, known), size).astype("<u8")
                    raw = found.tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    if not full and digest not in sketched:
                        sketched[digest] = registers(found).tobytes()
                    rows.append((digest, raw) if full else (len(found), digest, sketched[digest]))
                yield pd.DataFrame(rows, columns=["digest", "shingles"] if full else ["n_shingles", "digest", "sig"])
        finally:
            known.clear()
            sketched.clear()
            hand_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # else the optimizer calls it once for each field
    return rows.withColumn("_set", sets.asNondeterministic()("_text")).select("id", "_set.*")


def _hopeful(least: float):
    @F.pandas_udf("boolean")
    def hopeful(a: pd.Series, b: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(a), dtype="<u2").reshape(len(a), -1)
        right = np.frombuffer(b"".join(b), dtype="<u2").reshape(len(b), -1)
        return pd.Series(estimate(left, right) >= least)

    return hopeful


def _confirmed(percent: int):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return similar


def _sets_of(wanted: DataFrame, docs: DataFrame, size: int, columns: tuple[str, str]) -> tuple[DataFrame, str]:
    """(rep, digest, shingles) of the given classes (rep, digest), each once, and their
    folder: their texts are shingled again; the sets of all documents are never stored."""
    spark = docs.sparkSession
    id_col, text_col = columns
    wanted = checked(wanted, WANTED_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    texts = texts.join(wanted.select("rep"), "rep", "left_semi")
    sets = shingled(texts, size, "rep", "text", full=True).withColumnRenamed("id", "rep")
    asked = sets.join(wanted, ["rep", "digest"], "left_semi")
    found, path = settled_at(asked.dropDuplicates(["rep", "digest"]), "near-sets")
    forget_shuffles(spark)
    return found, path


def _shared_bands(classes: DataFrame) -> DataFrame:
    """(key, band, first, rep): the members of all bands that several classes share,
    and the smallest of them."""
    spark, count = classes.sparkSession, BUCKETS // BAND
    path = new_folder(spark, "shingle-bands")
    rounds = max(1, min(count, -(-classes.count() * count // ROUND_MEMBERS)))
    for start in range(rounds):
        keys = F.array(*[_band_key(i) for i in range(start, count, rounds)])
        members = classes.select("rep", F.explode(keys).alias("key"))
        # a band of one class only, whatever its texts, links nothing
        firsts = members.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
        several, several_path = settled_at(firsts.filter("first < last").select("key", "first"), "shingle-firsts")
        band = F.shiftrightunsigned("key", 64 - BAND_BITS).cast("int").alias("band")
        found = members.join(checked(several, WANTED_ROWS), "key").select("key", band, "first", "rep")
        found.write.mode("append").parquet(path)
        discard(spark, several_path)
        forget_shuffles(spark)
    return spark.read.schema("key long, band int, first long, rep long").parquet(path)


def _band_key(number: int) -> Column:
    """A hash of the band's registers below the band's number."""
    registers = F.substring("sig", 2 * BAND * number + 1, 2 * BAND)
    low = F.shiftrightunsigned(F.xxhash64(F.lit(number), registers), BAND_BITS)
    return low.bitwiseOR(F.shiftleft(F.lit(number).cast("long"), 64 - BAND_BITS))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("digest").alias("da"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("digest").alias("db"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").filter(_confirmed(percent)("sa", "sb")).select("a", "b").distinct()


def _shared_shingles(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with several non-empty ones."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    starts = np.cumsum([0, *[len(x) for x in others[:-1]]])
    return np.add.reduceat((own[at] == every).astype(np.int64), starts)


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id reachable over links.  Equal
    sets are one class, represented by their smallest id, so copies never meet in
    pairs.  Within a band every class is compared with the band's first; then,
    only where a band still holds several components, the classes outside its largest
    one are compared in blocks with all of other components.  No band is cut or skipped.

    Documents without words (null or empty text) have no shingle and are their own
    component.  Rows with a null id are linked with nothing: component_id is null
    and they are kept.  Repeated rows stay, rows of one id are one node.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    sketched, sketched_path = settled_at(shingled(docs, size, id_col, text_col), "shingles")
    # an id with several texts represents several classes: it links them anyway
    first = sketched.filter(USABLE).groupBy("digest").agg(F.min(F.struct("id", "sig")).alias("r"))
    classes = settled(first.select("digest", F.col("r.id").alias("rep"), F.col("r.sig").alias("sig")), "shingle-sets")
    # from here on only classes need their registers
    rows = settled(sketched.drop("sig"), "shingle-ids")
    discard(spark, sketched_path)
    forget_shuffles(spark)
    usable = rows.filter(USABLE)
    shared = _shared_bands(classes)

    least = percent / 100 - MARGIN
    pairs = shared.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    hopeful = _estimated(pairs, classes, least)
    ends = hopeful.select(F.explode(F.array("a", "b")).alias("rep"))
    wanted = settled(ends.distinct().join(classes.select("rep", "digest"), "rep"), "near-wanted")
    sets, sets_path = _sets_of(wanted, docs, size, (id_col, text_col))
    links = settled(_verified(hopeful, sets, percent), "near-links")
    discard(spark, sets_path)
    forget_shuffles(spark)
    groups = settled(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "near-groups"), "near-groups")

    # bands that the first comparison did not leave in one component
    placed = shared.join(groups, shared["rep"] == groups["node"], "left").select(
        "key", "band", "rep", F.coalesce("component", "rep").alias("c")
    )
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    unsettled = settled(placed.join(mixed.filter("low <> high").select("key"), "key"), "near-mixed")
    bundles = partitions_for(spark, unsettled.count(), BUNDLE)
    # sets are large: only those travel that some other's registers leave hope for
    asked = settled(unsettled.select("rep").distinct(), "near-mixed-reps")
    signed = classes.join(checked(asked, WANTED_ROWS), "rep", "left_semi")
    members = settled(_hopeful_members(_dealt(unsettled, bundles), signed, least), "near-members")
    forget_shuffles(spark)
    sets, _ = _sets_of(members.select("rep", "digest").distinct(), docs, size, (id_col, text_col))
    again = settled(_across(members, sets, least, percent), "near-candidates")
    sure = again.filter("sure").select("a", "b")
    forget_shuffles(spark)
    # those tried before cannot link two components: they would be in one
    large = again.filter("not sure").select("a", "b").join(pairs, ["a", "b"], "left_anti")
    edges = links.unionAll(sure).unionAll(_verified(large, sets, percent)).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    copies = usable.select("id", "digest").join(classes.select("digest", "rep"), "digest").filter("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    whole = components(edges.unionAll(copies), "near-duplicates")
    plain = rows.select("id", "n_shingles")
    out = plain.join(whole, plain["id"] == whole["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose registers leave hope; a pair with any hopeful sets stays,
    where one id stands for several."""
    ends = settled(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "near-ends")
    asked = classes.join(checked(ends, WANTED_ROWS), "rep", "left_semi")
    left = asked.select(F.col("rep").alias("a"), F.col("sig").alias("ga"))
    right = asked.select(F.col("rep").alias("b"), F.col("sig").alias("gb"))
    return settled(
        pairs.join(right, "b").join(left, "a").filter(_hopeful(least)("ga", "gb")).select("a", "b").distinct(), "near-hopeful"
    )


def _dealt(unsettled: DataFrame, bundles: int) -> DataFrame:
    """Members of mixed bands dealt to groups (bundle, x, y); ``main`` are those of the
    band's largest component, which need not meet each other.

    A band of more than ``BLOCK`` members is split into blocks of the others and blocks
    of the main ones, of about ``BLOCK`` members and at most ``MOST_BLOCKS`` of either.
    Each pair of blocks is one group, except pairs of main ones.  So a member goes to at
    most 2 * ``MOST_BLOCKS`` groups, and a main one beside few others to one.  Smaller
    bands are dealt to ``bundles`` groups.
    """
    sizes = unsettled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    bands = sizes.groupBy("key").agg(
        F.max_by("c", F.struct("n", "c")).alias("largest"), F.max("n").alias("m"), F.sum("n").alias("n")
    )
    blocks = lambda n: F.least(F.ceil(n / BLOCK), F.lit(MOST_BLOCKS)).cast("int")
    split = F.col("n") > BLOCK
    bands = bands.select(
        "key",
        "largest",
        F.when(split, blocks(F.col("n") - F.col("m"))).otherwise(1).alias("few"),
        F.when(split, blocks(F.col("m"))).otherwise(0).alias("many"),
    )
    bands = checked(settled(bands, "near-mixed-bands"), WANTED_ROWS)
    main, few, many, number = F.col("main"), F.col("few"), F.col("many"), F.xxhash64("rep")
    in_main = few + F.pmod(number, F.greatest(many, F.lit(1)))
    own = F.when(many == 0, 0).when(main, in_main).otherwise(F.pmod(number, few)).cast("int")
    last = F.when(main, few).otherwise(few + many) - 1
    spread = (
        unsettled.join(bands, "key")
        .withColumn("main", F.col("c") == F.col("largest"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    )
    return spread.select(
        "key",
        F.when(many == 0, F.pmod("key", F.lit(bundles))).otherwise(F.col("key")).alias("bundle"),
        "band",
        "rep",
        "c",
        "main",
        "own",
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
    )


def _candidates(rows: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Within the bands of a group (rows in order of key): the place of a member outside
    the main component and the places of those of another component that the registers
    leave hope for.  A pair is met once, in the first band that it shares."""
    sigs = np.frombuffer(b"".join(rows["sig"]), dtype="<u2").reshape(len(rows), -1)
    keys, reps, cs, mains, owns, bands = (rows[x].to_numpy() for x in ("key", "rep", "c", "main", "own", "band"))
    mixed = len(rows) and rows["x"].iloc[0] != rows["y"].iloc[0]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    for low, high in zip(starts, [*starts[1:], len(rows)], strict=True):
        number = int(bands[low])
        others = (low + np.flatnonzero(~mains[low:high])).tolist()
        # large blocks a part at a time, whose registers fit a cache
        for start in range(low, high, 2 * BLOCK):
            end = min(start + 2 * BLOCK, high)
            rep, c, main, own, sig = reps[start:end], cs[start:end], mains[start:end], owns[start:end], sigs[start:end]
            before = sig[:, : BAND * number].reshape(len(sig), number, BAND)
            for i in others:
                rest = np.flatnonzero((c != cs[i]) & (main | (rep > reps[i])) & ((own != owns[i]) if mixed else True))
                if len(rest):
                    rest = rest[estimate(sig[rest], sigs[i]) >= least]
                if len(rest) and number:
                    own_before = sigs[i, : BAND * number].reshape(number, BAND)
                    rest = rest[~(before[rest] == own_before).all(axis=2).any(axis=1)]
                if len(rest):
                    yield i, start + rest


def _hopeful_members(dealt: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The dealt members, with digests and registers of their classes, that are in any
    candidate pair."""
    signed = dealt.join(classes.select("rep", "digest", "sig"), "rep")
    kept = ["key", "bundle", "band", "rep", "c", "main", "own", "x", "y", "digest", "sig"]

    def hopeful(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        found = np.zeros(len(rows), bool)
        for i, rest in _candidates(rows, least):
            found[i] = True
            found[rest] = True
        return rows.loc[found, kept]

    shape = "key long, bundle long, band int, rep long, c long, main boolean, own int, x int, y int, digest binary, sig binary"
    return signed.groupBy("bundle", "x", "y").applyInPandas(hopeful, shape)


def _across(members: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b, sure) of different components within a band, a < b: links by
    their full sets (sure), and candidates with a set of over ``HELD`` shingles."""
    held = F.when(F.octet_length("shingles") <= 8 * HELD, F.col("shingles")).alias("held")
    signed = members.join(sets.select("rep", "digest", held), ["rep", "digest"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        reps = rows["rep"].to_numpy()
        full = [None if x is None else np.frombuffer(x, dtype="<u8") for x in rows["held"]]
        large = np.array([x is None for x in full], dtype=bool)
        a, b, sure = [], [], []
        for i, rest in _candidates(rows, least):
            known = np.zeros(len(rest), bool) if large[i] else ~large[rest]
            linked = ~known
            if known.any():
                own_set, others = full[i], [full[j] for j in rest[known]]
                both = _shared_shingles(own_set, others)
                union = len(own_set) + np.array([len(x) for x in others]) - both
                linked[known] = 100 * both >= percent * union
            a.append(np.minimum(reps[rest[linked]], reps[i]))
            b.append(np.maximum(reps[rest[linked]], reps[i]))
            sure.append(known[linked])
        none = np.zeros(0, dtype="int64")
        certain = np.concatenate([none.astype(bool), *sure])
        return pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b]), "sure": certain})

    return signed.groupBy("bundle", "x", "y").applyInPandas(compare, "a long, b long, sure boolean").distinct()
