"""Packing token sequences by linear grouping, configurations and best fit.

The pieces to pack have at most ``capacity`` tokens, so the problem is known
completely by its histogram: one count per length.  The driver plans on that
histogram alone (at most ``capacity`` rows at any input size); Spark counts the
lengths, numbers the pieces of each length and joins them to their slots.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import arrow_rows, hand_back, partitions_for, settled

CAPACITY = 1024
#: Lengths up to this share of the capacity are small and best-fit at the end.
SMALL_SHARE = 1 / 16
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 128
#: Share of the fractional optimum at which configurations are good enough.
PRICE_GAP = 5e-4
#: Rows of one length that one task numbers.
RANK_ROWS = 200_000


# -- planning on the histogram -------------------------------------------------


def grouped(large: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, longest first, cut into groups of equal cardinality: for each
    the rounded length (its longest) and its (length, count) parts."""
    total = sum(large.values())
    size = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(large, reverse=True):
        left = large[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            take = min(left, room)
            out[-1][1].append((length, take))
            left, room = left - take, room - take
    return out


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: copies of each size with the highest total value."""
    best = np.zeros(capacity + 1)
    copies = np.zeros((len(sizes), capacity + 1), dtype=np.int16)
    for i, (value, size) in enumerate(zip(values.tolist(), sizes.tolist(), strict=True)):
        if value <= 1e-12:
            continue
        for n in range(1, capacity // size + 1):
            # one more copy on top of exactly n - 1 copies of this size
            before, more = copies[i, :-size] == n - 1, best[:-size] + value
            better = before & (more > best[size:] + 1e-12)
            if not better.any():
                break
            best[size:] = np.where(better, more, best[size:])
            copies[i, size:][better] = n
    picked, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        picked[i] = copies[i, room]
        room -= int(picked[i] * sizes[i])
    return picked


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = PRICE_GAP) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the cutting-stock problem over few sizes, by column
    generation: (copies of each size, how many such sequences).  It ends when no
    configuration promises more than ``gap``, so it is within that share of the
    optimum."""
    n = len(sizes)
    patterns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    inverse = np.diag(1 / np.diag(patterns))
    # element-wise sums: the matrices are small and need no threaded library
    amount = (inverse * demand).sum(axis=1)
    for _ in range(100 * n + 1000):
        prices = inverse.sum(axis=0)
        new = _knapsack(prices, sizes, capacity).astype(float)
        if (prices * new).sum() <= 1 + gap:
            break
        direction = (inverse * new).sum(axis=1)
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.full(n, np.inf)
        ratio[ok] = np.maximum(amount[ok], 0) / direction[ok]
        out = int(ratio.argmin())
        amount = amount - ratio[out] * direction
        amount[out] = ratio[out]
        patterns[:, out] = new
        row = inverse[out] / direction[out]
        inverse = inverse - direction[:, None] * row
        inverse[out] = row
    return [(patterns[:, j].astype(np.int64), float(amount[j])) for j in range(n) if amount[j] > 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences for all pieces of the histogram: (how many, lengths in each).

    Full pieces stand alone.  Large lengths are rounded up within groups of
    equal cardinality; configurations of the rounded lengths are optimised, cut
    to whole numbers, and filled with true lengths.  What rounding down left
    over, and then all small lengths, go by decreasing length to the fullest
    sequence that still has room.
    """
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    done: Counter[tuple[int, ...]] = Counter()
    if capacity in counts:
        done[(capacity,)] += counts.pop(capacity)
    small_most = int(capacity * SMALL_SHARE)
    large = {k: v for k, v in counts.items() if k > small_most}
    loose = Counter({k: v for k, v in counts.items() if k <= small_most})
    open_: Counter[tuple[int, ...]] = Counter()
    if large:
        parts = grouped(large, groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for rounded, members in parts:
            merged.setdefault(rounded, []).extend(members)
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(c for _, c in merged[s]) for s in sizes])
        queues = [[list(x) for x in merged[s]] for s in sizes]
        for pattern, amount in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            slots = [i for i, c in enumerate(pattern) for _ in range(int(c))]
            left = int(amount + 1e-6)
            while left and slots:
                # as many equal sequences as the front of each queue gives
                need = Counter(slots)
                fronts, run = [], left
                for i, c in need.items():
                    taken: list[int] = []
                    while len(taken) < c and queues[i]:
                        length, have = queues[i][0]
                        use = min(have, c - len(taken))
                        if use == have and len(taken) + use < c or use < c:
                            # mixed lengths: settle one sequence
                            run = 1
                        taken += [length] * use
                        queues[i][0][1] -= use
                        if not queues[i][0][1]:
                            queues[i].pop(0)
                    if run > 1 and len(taken) == c:
                        length = taken[0]
                        more = queues[i][0][1] // c if queues[i] and queues[i][0][0] == length else 0
                        run = min(run, 1 + more)
                    fronts.append((i, taken))
                if not any(taken for _, taken in fronts):
                    break
                if run > 1:
                    for i, taken in fronts:
                        queues[i][0][1] -= len(taken) * (run - 1)
                        if not queues[i][0][1]:
                            queues[i].pop(0)
                open_[tuple(sorted((x for _, taken in fronts for x in taken), reverse=True))] += run
                left -= run
        for queue in queues:
            for length, have in queue:
                loose[length] += have
    rooms: dict[int, Counter[tuple[int, ...]]] = {}
    for lengths, n in open_.items():
        rooms.setdefault(capacity - sum(lengths), Counter())[lengths] += n
    for length in sorted(loose, reverse=True):
        left = loose[length]
        while left:
            room = min((r for r, kinds in rooms.items() if r >= length and kinds), default=None)
            if room is None:
                each = capacity // length
                for copies in (each, left % each if left >= each else left):
                    n = left // copies if copies else 0
                    if n:
                        rooms.setdefault(capacity - copies * length, Counter())[(length,) * copies] += n
                        left -= n * copies
                continue
            kinds = rooms[room]
            lengths = next(iter(kinds))
            n = kinds[lengths]
            copies = min(room // length, left)
            n = min(n, left // copies)
            kinds[lengths] -= n
            if not kinds[lengths]:
                del kinds[lengths]
            rooms.setdefault(room - copies * length, Counter())[lengths + (length,) * copies] += n
            left -= n * copies
    for kinds in rooms.values():
        done.update(kinds)
    return [(n, lengths) for lengths, n in done.items() if n]


def slots(planned: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots: pieces of ``length`` ranked from ``rank_from`` to before
    ``rank_to`` go to sequences ``first``, ``first + step``... at ``offset``."""
    used: Counter[int] = Counter()
    out, first = [], 0
    for n, lengths in planned:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + n, first, offset))
            used[length] += n
            offset += length
        first += n
    return out


# -- Spark ---------------------------------------------------------------------


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length`` column of 1..capacity) plus sequence_id and
    offset.  ``order`` names columns that tell pieces apart; pieces alike in
    them and in length are interchangeable, and numbered in any order.

    Pieces of one length are numbered in buckets of their order columns' hash,
    so a length that a third of all pieces share is spread over many tasks; the
    number of buckets grows with the input.  The histogram (at most ``capacity``
    rows) is all that reaches the driver; the slot table it returns has a few
    thousand rows, bounded by capacity and groups, not by the input.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = partitions_for(spark, total, RANK_ROWS)
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = settled(counts, "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_own"))
    schema = "length long, _from long, _to long, _first long, offset long"
    table = spark.createDataFrame(runs, schema)
    hit = (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    # proven bound: a few thousand runs, see above
    placed = ranked.join(F.broadcast(table), hit).drop(table["length"])
    return placed.withColumn("sequence_id", F.col("_first") + F.col("_rank") - F.col("_from")).drop(
        "_bucket", "_own", "_start", "_rank", "_from", "_to", "_first"
    )


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"
#: The pattern by which byte-level BPE files split words (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Split of a text into parts whose tokens do not depend on each other.
PARTS = r" ?\S+|\s+(?!\S)|\s+"
#: Parts that a Python worker remembers (about 55 MB); later ones are encoded
#: whenever they occur.
REMEMBERED = 250_000
#: Of these so many outlive their task.
KEPT = 50_000


def byte_vocabulary(model: dict) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level BPE file, if its merges come in the
    order of the ids they make; else None."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) != len(made):
        return None
    singles = {x: i for x, i in vocabulary.items() if len(x) == 1}
    if len(singles) != 256 or set(singles) != set(byte_of):
        return None
    whole = singles | {x: vocabulary[x] for x in ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])}
    return {bytes(byte_of[c] for c in x): i for x, i in whole.items()}


class ByteBpe:
    """Token ids of whole texts by a tokenizers file, as little-endian uint32.

    Words between single spaces are encoded once and remembered, because the
    library splits there as well.  Texts that hold a special token's string or an
    ASCII separator (white space to one library and not to the other) are
    encoded whole by tokenizers.  Parts go through tiktoken's merges of the same
    file where its merges are ordered as its ids, which gives the same ids
    several times faster; else through tokenizers as well.
    """

    def __init__(self, model: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model)
        self.model.no_truncation()
        self.model.no_padding()
        added = self.model.get_added_tokens_decoder().values()
        self.whole = ["\x1c", "\x1d", "\x1e", "\x1f", *(x.content for x in added)]
        self.parts = re.compile(PARTS).findall
        self.known: dict[str, bytes] = {}
        with open(model, encoding="utf-8") as file:
            ranks = byte_vocabulary(json.load(file)["model"])
        self.part = self.plain
        if ranks:
            import tiktoken

            fast = tiktoken.Encoding("parts", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.part = lambda text: array("I", fast.encode_ordinary(text)).tobytes()

    def forget(self) -> None:
        """Drop the remembered words beyond what a stage needs to start quickly."""
        if len(self.known) > KEPT:
            self.known = dict(list(self.known.items())[:KEPT])

    def plain(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.whole):
            return self.plain(text)
        if "  " in text:
            return b"".join(map(self.part, self.parts(text)))
        # with single spaces, each word and the space before it stand alone
        first, *words = text.split(" ")
        known = self.known
        try:
            return self.part(first) + b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        seen = known
        missing = set(words).difference(known)
        if len(known) + len(missing) > REMEMBERED:
            seen = {x: known[x] for x in set(words) - missing}
        for x in missing:
            seen[x] = self.part(" " + x)
        return self.part(first) + b"".join(map(seen.__getitem__, words))


_loaded: dict[str, ByteBpe] = {}


def loaded(model: str) -> ByteBpe:
    """One encoder per Python worker and file, kept from task to task."""
    if model not in _loaded:
        _loaded[model] = ByteBpe(model)
    return _loaded[model]


def token_pieces(
    docs: DataFrame,
    model: str,
    end_id: int | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids).

    A document is its text's ids followed by ``end_id``; only a longer one is
    cut, its first piece taking the remainder.  ``ids`` holds little-endian
    unsigned 32-bit numbers.  Null texts are empty; a document without any token
    (empty, no end id) has no piece; null ids and repeated rows stay.
    """
    arrow_rows(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = loaded(model)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        try:
            for batch in batches:
                rows, doc = [], []
                for at, text in enumerate(batch["_text"].tolist()):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    stop = n % capacity or min(n, capacity)
                    start = piece = 0
                    while start < n:
                        doc.append(at)
                        rows.append((piece, start, stop - start, ids[4 * start : 4 * stop]))
                        start, stop, piece = stop, stop + capacity, piece + 1
                out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids"])
                # no null among the ids, which would turn large ones into other doubles
                ids, missing = batch["_id"].to_numpy()[doc], batch["_no_id"].to_numpy()[doc]
                out.insert(0, "doc_id", pd.arrays.IntegerArray(ids, missing))
                yield out
        finally:
            encode.forget()
            hand_back()

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"), doc_id.isNull().alias("_no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    return rows.mapInPandas(cut, PIECE_SCHEMA)
