"""Language-model scores by a hierarchical Pitman-Yor model.

Every context is a restaurant: the words that followed it are its customers,
seated at tables that each serve one word.  A new table asks the parent
restaurant, which all contexts share, for its word; so the parent's customers
are the tables below it, and its own new tables draw from a uniform base.  The
seating is sampled by Gibbs sweeps, and the predictive probabilities of several
sweeps are averaged.

The context of a token is the word before it, by its whole 64-bit hash.  Pairs
(word, context) are dealt to buckets by the word, those of very common words by
word and context, so that no word is gathered in one place.  A word's part of
the parent restaurant lies in its own bucket; of the at most 1,000 common words
the driver holds a few numbers each.  A bucket keeps the totals of the contexts
it meets: between sweeps, buckets send what they have seated per context to the
context's place, where it is added up and sent back (``_context_totals``).
Within a sweep all totals are those of the sweep before, as usual for
distributed Gibbs sampling.  Pairs of held-out texts are in the buckets with no
customers, so that their contexts' totals come the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import arrow_rows, discard, forget_shuffles, new_folder, settled

#: The context of the first token of a text.
START = np.uint64(0)
#: Tokens that one worker gathers before it sends them off.
SLICE_TOKENS = 1_500_000
SLICE_DOCS = 60_000
#: Words that one worker remembers.
KNOWN_WORDS = 300_000
#: Texts are scored in so many rounds, of this many bytes of text at least, so that
#: only one round's tokens lie on the disks at a time.
ROUNDS = 3
ROUND_BYTES = 64 << 20
#: Bytes of text per bucket of words.
BUCKET_BYTES = 14 << 20
#: Words with about this share of a sample of the texts or more are dealt by word
#: and context; pairs with this share of all tokens (at most 500) are scored where
#: the texts are read.  Neither changes what is counted.
HEAVY_SHARE = 1 / 500
SAMPLE_BYTES = 16 << 20
BURN_IN, SAMPLES = 1, 2
CONCENTRATION = 1.0
#: Customers seated one by one; later ones in blocks that double.
ONE_BY_ONE = 32
FOLDS, HELD_OUT = 7, 2


def pack(x: np.ndarray) -> bytes:
    """An array of whole numbers in the fewest bytes each, its type first, as
    compressed planes of bytes; ascending hashes as their steps."""
    small = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    if small.itemsize == 8:
        if len(small) > 1 and small.dtype.kind == "u" and (small[1:] > small[:-1]).all():
            return b"+" + _pack_steps(small)
        return small.dtype.char.encode() + small.tobytes()
    planes = small.view(np.uint8).reshape(-1, small.itemsize).T.tobytes()
    return small.dtype.char.encode() + zlib.compress(planes, 1)


def _pack_steps(ascending: np.ndarray) -> bytes:
    """The first number, the width of a step in bytes, and the steps' planes: of
    random hashes only the uppermost two are worth compressing."""
    steps = (ascending[1:] - ascending[:-1]).astype("<u8")
    width = -(-int(steps.max()).bit_length() // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    low = planes[: max(0, width - 2)].tobytes()
    return ascending[:1].astype("<u8").tobytes() + bytes([width]) + len(steps).to_bytes(8, "little") + low + zlib.compress(planes[max(0, width - 2) :].tobytes(), 1)


def _unpack_steps(raw: memoryview) -> np.ndarray:
    width, n = raw[8], int.from_bytes(raw[9:17], "little")
    plain = max(0, width - 2)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :plain] = np.frombuffer(raw, dtype=np.uint8, offset=17, count=plain * n).reshape(plain, n).T
    steps[:, plain:width] = np.frombuffer(zlib.decompress(raw[17 + plain * n :]), dtype=np.uint8).reshape(width - plain, n).T
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = np.frombuffer(raw, dtype="<u8", count=1)[0]
    out[1:] = steps.view("<u8").reshape(-1)
    return np.cumsum(out, dtype=np.uint64)


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"+":
        return _unpack_steps(memoryview(raw)[1:])
    kind = np.dtype(chr(raw[0]))
    if kind.itemsize == 8:
        return np.frombuffer(raw, dtype=kind, offset=1)
    planes = np.frombuffer(zlib.decompress(memoryview(raw)[1:]), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _end_hash() -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"", seed=1)


class _Numbers(dict):
    """Words numbered from 1 on, as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


class Tokens:
    """Texts as numbers of their words, gathered in slices."""

    def __init__(self) -> None:
        self.end = _end_hash()
        self.forget()
        self.clear()

    def forget(self) -> None:
        """The known words, and the hashes of those met in slices before; 0 is the end."""
        self.known = _Numbers()
        self.hashes = np.array([self.end], dtype=np.uint64)

    def clear(self) -> None:
        # numbers of words hold for the whole slice
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.ids: list = []
        self.flags: list[bool] = []
        self.total = 0

    def add(self, doc_id, held_out: bool, text: str) -> None:
        words = text.encode("utf-8", "replace").lower().split()
        numbers = np.zeros(len(words) + 1, dtype=np.int32)
        numbers[:-1] = np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))
        self.parts.append(numbers)
        self.sizes.append(len(numbers))
        self.ids.append(doc_id)
        self.flags.append(held_out)
        self.total += len(numbers)

    @property
    def full(self) -> bool:
        return self.total >= SLICE_TOKENS or len(self.sizes) >= SLICE_DOCS or len(self.known) > KNOWN_WORDS

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of the slice's words, ascending, and each token's
        place among them."""
        import xxhash

        new = islice(self.known, len(self.hashes) - 1, None)
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64)])
        numbers = np.concatenate(self.parts)
        used = np.flatnonzero(np.bincount(numbers, minlength=len(self.hashes)))
        hashes, at = np.unique(self.hashes[used], return_inverse=True)
        place = np.empty(len(self.hashes), dtype=np.int64)
        place[used] = at
        return hashes, place[numbers]

    def dealt(self, heavy: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, contexts and documents of all tokens by bucket, word and
        context, and where each bucket begins and ends.  A context is its place
        among the hashes, which come last."""
        vocabulary, ids = self.vocabulary()
        sizes = np.array(self.sizes)
        context = np.empty(len(ids), dtype=np.int64)
        context[1:] = ids[:-1] + 1
        context[np.cumsum(sizes) - sizes] = 0
        order = _order(ids * (len(vocabulary) + 1) + context, (len(vocabulary) + 1) ** 2)
        context, ids = context[order], ids[order]
        words = vocabulary[ids]
        # the start sorts before all words, whatever their hashes
        hashes = np.concatenate([[START], vocabulary])
        bucket = _bucket(words, hashes[context], heavy, buckets)
        del ids
        again = (bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket).argsort(kind="stable")
        edges = np.searchsorted(bucket[again], np.arange(buckets + 1))
        return words[again], context[again], np.repeat(np.arange(len(sizes)), sizes)[order][again], edges, hashes


def _order(keys: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of keys from 0 to below ``limit``: sorted with their places in
    the low bits where both fit, which is several times faster."""
    bits = max(1, len(keys)).bit_length()
    if limit.bit_length() + bits > 63:
        return keys.argsort(kind="stable")
    return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)


def _place(hashes: np.ndarray, places: int) -> np.ndarray:
    """Ranges of the hash, so ascending with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int32)


def _bucket(words: np.ndarray, contexts: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    hashes = words.copy()
    _, common = _find(heavy, words)
    mixed = (words[common] ^ contexts[common] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    hashes[common] = mixed ^ mixed << np.uint64(32)
    return _place(hashes, buckets)


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), dtype=int), np.zeros(len(what), dtype=bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[Tokens]:
    tokens = Tokens()
    for batch in batches:
        for doc_id, missing, held, text in zip(batch["id"], batch["no_id"], batch["held_out"], batch["text"], strict=True):
            tokens.add(None if missing else int(doc_id), held, text)
            if tokens.full:
                yield tokens
                tokens.clear()
    if tokens.sizes:
        yield tokens
        tokens.clear()


def _firsts(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Where a new pair begins among sorted ones."""
    new = (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])
    return np.flatnonzero(np.concatenate([[True], new]))


def _block(words: np.ndarray, contexts: np.ndarray, hashes: np.ndarray | None = None) -> tuple[bytes, bytes, bytes, bytes]:
    """Rows sorted by word: the words, rows of each, the distinct contexts
    ascending (heads), and each row's place among them.  With ``hashes``, contexts
    are places in them."""
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    heads, at = np.unique(contexts, return_inverse=True)
    if hashes is not None:
        # a word may hash to the start's number
        heads, same = np.unique(hashes[heads], return_inverse=True)
        at = same[at]
    return pack(words[starts]), pack(np.diff(starts, append=len(words))), pack(heads), pack(at)


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words = np.repeat(unpack(row["words"]).astype(np.uint64), unpack(row["sizes"]).astype(np.int64))
    return words, unpack(row["heads"]).astype(np.uint64)[unpack(row["contexts"]).astype(np.int64)]


@dataclass
class Sample:
    """What one sweep leaves to all: customers and tables of the parent, and of
    each common word its tables and the parent's tables."""

    parent_customers: float
    parent_tables: float
    heavy_tables: np.ndarray
    heavy_parents: np.ndarray


@dataclass
class Rules:
    heavy: np.ndarray
    heavy_counts: np.ndarray
    discount: float
    parent_discount: float
    words: int
    tokens: int

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)


def parent_probability(tables: np.ndarray, parent: np.ndarray, rules: Rules, state: Sample) -> np.ndarray:
    """p(word) in the shared restaurant, from its customers and tables."""
    back = (CONCENTRATION + rules.parent_discount * state.parent_tables) * rules.base
    return (tables - rules.parent_discount * parent + back) / (CONCENTRATION + state.parent_customers)


def seat(customers: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that so many customers of one dish open: each sits at a table of
    the dish with weight (customers - discount * tables), or opens one with
    weight ``strength``.  The first opens one.  Beyond ``ONE_BY_ONE`` customers,
    blocks [j, 2j) open a Poisson number at their middle rate."""
    tables = np.minimum(customers, 1).astype(np.float64)
    rest = np.flatnonzero(customers > 1)
    j = 1
    while len(rest):
        block = 1 if j < ONE_BY_ONE else j
        many = np.minimum(customers[rest] - j, block)
        seated = j + (block - 1) / 2
        a = strength[rest]
        chance = a / np.maximum(a + seated - discount * tables[rest], a)
        if block == 1:
            new = rng.random(len(rest)) < chance
        else:
            new = np.minimum(rng.poisson(many * chance), many)
        tables[rest] += new
        j += block
        rest = rest[customers[rest] > j]
    return tables


COUNTS = "bucket int, words binary, sizes binary, heads binary, contexts binary, counts binary"
#: ``totals``: of each head its customers, then its tables in each kept sweep;
#: ``own``: what this bucket adds to the totals that are not yet known;
#: ``heavy``: this bucket's tables (at first also customers) of each common word.
STATE = COUNTS + ", tables array<binary>, parents array<binary>, totals array<binary>, own array<binary>, heavy array<long>, figures array<long>"
FIXED = ["bucket", "words", "sizes", "heads", "contexts", "counts"]


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number = F.crc32(F.col(id_col).cast("string")) % FOLDS
    return docs.select(
        # no null among the ids: pandas would turn large ones into other doubles
        F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id"),
        F.col(id_col).cast("long").isNull().alias("no_id"),
        F.coalesce(number == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _common_words(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of the words that are common in a sample, at most 1,000, ascending."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens in _slices(batches):
            words, at = tokens.vocabulary()
            n = np.bincount(at)
            often = n >= n.sum() * HEAVY_SHARE / 4
            yield pd.DataFrame({"word": words[often].view(np.int64), "n": n[often], "total": n.sum()})

    part = rows if size <= SAMPLE_BYTES else rows.sample(SAMPLE_BYTES / size, seed=11)
    found = settled(part.mapInPandas(pick, "word long, n long, total long"), "lm-common")
    # every worker names a total with each word; the largest word's share bounds it
    total = found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = total.agg(F.max("total")).head()[0] or 0
    common = total.filter(F.col("n") >= max(1, whole * HEAVY_SHARE / 2)).orderBy(F.desc("n"), "word").limit(1000)
    return np.sort(np.array([r["word"] for r in common.collect()], dtype=np.int64).view(np.uint64))


def counted(rows: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """Pairs with their training tokens, one row per bucket; every word has one
    table in each of its contexts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens in _slices(batches):
            words, contexts, doc, edges, hashes = tokens.dealt(heavy, buckets)
            learned, out = ~np.array(tokens.flags, dtype=bool), []
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    w, c = words[edges[b] : edges[b + 1]], contexts[edges[b] : edges[b + 1]]
                    first = _firsts(w, c)
                    n = np.add.reduceat(learned[doc[edges[b] : edges[b + 1]]].astype(np.int64), first)
                    out.append((b, *_block(w[first], c[first], hashes), pack(n)))
            yield pd.DataFrame(out, columns=FIXED)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        pairs = [_pairs(r) for r in part.to_dict("records")]
        words, contexts = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
        del pairs
        n = np.concatenate([unpack(x).astype(np.int64) for x in part["counts"]])
        order = np.lexsort((contexts, words))
        words, contexts, n = words[order], contexts[order], n[order]
        first = _firsts(words, contexts)
        counts = np.add.reduceat(n, first)
        row = dict(zip(FIXED, (int(part["bucket"].iloc[0]), *_block(words[first], contexts[first]), pack(counts)), strict=True))
        model = _Bucket(row, heavy)
        tables = np.minimum(counts, 1)
        sizes = np.add.reduceat(tables, model.starts)
        kinds = sizes[~model.common]
        figures = [counts.sum(), (kinds > 0).sum(), (counts == 1).sum(), (counts == 2).sum(), (kinds == 1).sum(), (kinds == 2).sum()]
        row |= model.seated(tables, np.where(model.common, 0, np.minimum(sizes, 1)), [model.by_head(counts)])
        row |= {"heavy": [*row["heavy"], *model.by_common(counts)], "figures": row["figures"] + [int(x) for x in figures]}
        return pd.DataFrame([row])

    return rows.mapInPandas(count, COUNTS).groupBy("bucket").applyInPandas(merge, STATE)


class _Bucket:
    """The pairs of one bucket."""

    def __init__(self, row: dict, heavy: np.ndarray):
        self.row, self.heavy = row, heavy
        self.words = unpack(row["words"]).astype(np.uint64)
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.contexts = unpack(row["contexts"]).astype(np.int64)
        self.counts = unpack(row["counts"]).astype(np.int64)
        self.at_common, self.common = _find(heavy, self.words)

    def by_head(self, x: np.ndarray) -> bytes:
        return pack(np.bincount(self.contexts, weights=x).astype(np.int64))

    def by_common(self, x: np.ndarray) -> list[int]:
        own = np.add.reduceat(x, self.starts)[self.common]
        return np.bincount(self.at_common[self.common], weights=own, minlength=len(self.heavy)).astype(np.int64).tolist()

    def parent(self, tables: np.ndarray, parents: np.ndarray, rules: Rules, state: Sample) -> np.ndarray:
        """p(word) of each word: from its own tables here, or the driver's."""
        own = np.add.reduceat(tables.astype(np.float64), self.starts)
        own[self.common] = state.heavy_tables[self.at_common[self.common]]
        parents = parents.astype(np.float64)
        parents[self.common] = state.heavy_parents[self.at_common[self.common]]
        return parent_probability(own, parents, rules, state)

    def seated(self, tables: np.ndarray, parents: np.ndarray, own: list[bytes]) -> dict:
        return {
            "tables": [pack(tables)],
            "parents": [pack(parents)],
            "totals": [],
            "own": [*own, self.by_head(tables)],
            "heavy": self.by_common(tables),
            "figures": [int(tables.sum()), int(parents.sum())],
        }


SENT = "place int, bucket int, heads binary, own array<binary>"


def _context_totals(state: DataFrame, places: int) -> DataFrame:
    """(bucket, place, own): what all buckets hold of each of the bucket's heads.
    A bucket sends one number per context, so a common context is as many
    numbers as there are buckets."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                heads, own = unpack(r["heads"]).astype(np.uint64), [unpack(x) for x in r["own"]]
                edges = np.searchsorted(_place(heads, places), np.arange(places + 1))
                out = [
                    (i, r["bucket"], pack(heads[edges[i] : edges[i + 1]]), [pack(x[edges[i] : edges[i + 1]]) for x in own])
                    for i in range(places)
                    if edges[i] < edges[i + 1]
                ]
                yield pd.DataFrame(out, columns=["place", "bucket", "heads", "own"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        heads = [unpack(x) for x in part["heads"]]
        ends = np.cumsum([len(x) for x in heads])[:-1]
        _, at = np.unique(np.concatenate(heads), return_inverse=True)
        sums = []
        for k in range(len(part["own"].iloc[0])):
            all_of = np.bincount(at, weights=np.concatenate([unpack(x[k]).astype(np.float64) for x in part["own"]]))
            sums.append([pack(x) for x in np.split(all_of[at].astype(np.int64), ends)])
        return pd.DataFrame({"bucket": part["bucket"].to_numpy(), "place": part["place"].to_numpy(), "own": [list(x) for x in zip(*sums, strict=True)]})

    sent = state.select("bucket", "heads", "own").mapInPandas(send, SENT)
    return sent.groupBy("place").applyInPandas(add, "bucket int, place int, own array<binary>")


def _all_totals(row: dict, places: list[int], own: list) -> list[np.ndarray]:
    """The known totals of a bucket's heads and those just sent back."""
    ordered = [x for _, x in sorted(zip(places, own, strict=True), key=lambda x: x[0])]
    new = [np.concatenate([unpack(x[k]).astype(np.float64) for x in ordered]) for k in range(len(row["own"]))]
    return [*(unpack(x).astype(np.float64) for x in row["totals"]), *new]


def _sweep(state: DataFrame, buckets: int, rules: Rules, before: Sample, number: int, keep: bool) -> DataFrame:
    """Every bucket seated anew given the totals of the sweep before.  ``keep``
    appends to the kept seatings instead of replacing the last."""

    def run(part: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        r = part.to_dict("records")[0]
        totals = _all_totals(r, sums["place"].tolist(), sums["own"].tolist())
        model = _Bucket(r, rules.heavy)
        rng = np.random.default_rng([number, int(r["bucket"])])
        p = model.parent(unpack(r["tables"][-1]), unpack(r["parents"][-1]), rules, before)
        strength = (CONCENTRATION + rules.discount * totals[-1][model.contexts]) * np.repeat(p, model.sizes)
        tables = seat(model.counts, strength, rules.discount, rng)
        own = np.where(model.common, 0, np.add.reduceat(tables, model.starts))
        row = {k: r[k] for k in FIXED}
        row |= model.seated(tables, _parent_seats(own, rules, before, rng), [])
        row["totals"] = [pack(x) for x in (totals if keep else totals[:1])]
        if keep:
            row["tables"], row["parents"] = [*r["tables"], *row["tables"]], [*r["parents"], *row["parents"]]
        return pd.DataFrame([row])

    sums = _context_totals(state, buckets)
    return state.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInPandas(run, STATE)


def _parent_seats(tables: np.ndarray, rules: Rules, before: Sample, rng: np.random.Generator) -> np.ndarray:
    back = (CONCENTRATION + rules.parent_discount * before.parent_tables) * rules.base
    return seat(tables, np.full(len(tables), back), rules.parent_discount, rng)


def _sums(df: DataFrame, column: str, length: int) -> np.ndarray:
    """Sum of an array column of a bounded length."""
    out = np.zeros(length)
    for r in df.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def _sample(state: DataFrame, rules: Rules, before: Sample | None, number: int) -> Sample:
    customers, parents = _sums(state.select(F.slice("figures", 1, 2).alias("figures")), "figures", 2)
    tables = _sums(state.select(F.slice("heavy", 1, max(1, len(rules.heavy))).alias("heavy")), "heavy", len(rules.heavy))
    own = np.minimum(tables, 1) if before is None else _parent_seats(tables, rules, before, np.random.default_rng([number, 1 << 32]))
    return Sample(float(customers), float(parents + own.sum()), tables, own)


def _rules(state: DataFrame, heavy: np.ndarray) -> Rules:
    """Corpus size, and discounts from counts of counts."""
    n, v, one, two, one_word, two_word = (int(x) for x in _sums(state, "figures", 8)[2:])
    tables, counts = _sums(state, "heavy", 2 * len(heavy)).reshape(2, -1)

    def discount(a: int, b: int) -> float:
        return min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5

    below = discount(one_word + int((tables == 1).sum()), two_word + int((tables == 2).sum()))
    return Rules(heavy, counts.astype(np.int64), discount(one, two), below, v + int((tables > 0).sum()), n)


class Predictive:
    """Averaged predictive probabilities of the pairs of one bucket."""

    def __init__(self, row: dict, totals: list[np.ndarray], rules: Rules, samples: list[Sample]):
        model = _Bucket(row, rules.heavy)
        self.words, self.starts, self.sizes = model.words, model.starts, model.sizes
        self.heads = unpack(row["heads"]).astype(np.uint64)
        self.codes = np.repeat(np.arange(len(model.sizes)), model.sizes) * len(self.heads) + model.contexts
        word_counts = np.add.reduceat(model.counts, model.starts)
        word_counts[model.common] = rules.heavy_counts[model.at_common[model.common]]
        self.counts = np.repeat(word_counts, model.sizes)
        total = np.zeros(len(model.counts))
        for tables, parents, seated, s in zip(row["tables"], row["parents"], totals[1:], samples, strict=True):
            tables = unpack(tables).astype(np.float64)
            p = np.repeat(model.parent(tables, unpack(parents), rules, s), model.sizes)
            total += model.counts - rules.discount * tables + (CONCENTRATION + rules.discount * seated[model.contexts]) * p
        self.logs = np.log10(total / (CONCENTRATION + totals[0][model.contexts]) / len(samples))

    def holds(self, word: np.uint64, context: np.uint64) -> bool:
        code = np.searchsorted(self.words, word) * len(self.heads) + np.searchsorted(self.heads, context)
        return bool(_find(self.codes, np.array([code]))[1][0])

    def score(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of each word after its context;
        every pair of a text is among the bucket's."""
        at = np.searchsorted(self.codes, np.searchsorted(self.words, words) * len(self.heads) + np.searchsorted(self.heads, contexts))
        return self.logs[at], self.counts[at]


#: Rows of a negative slice are totals of contexts, sent from place -1 - slice.
EVENTS = "bucket int, slice long, words binary, sizes binary, heads binary, contexts binary, docs binary, own array<binary>"
PARTS = "slice long, docs binary, n binary, score binary, base binary"
SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity).

    Learns from every document whose crc32(id as text) mod 7 is not 2 (null ids
    learn too).  Tokens are the words, A-Z lower-cased, and an end; a null or
    empty text is its end alone.  ``base_score`` is the add-one unigram score,
    ``score`` the log10 probability of the text under the averaged model.  With
    nothing to learn from both are 0.  Repeated rows stay.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = _prepared(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    # bucket rows are large: few in an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    heavy = _common_words(rows, size)
    path = new_folder(spark, "lm-seats")
    counted(rows, heavy, buckets).write.parquet(path)
    state = spark.read.schema(STATE).parquet(path)
    forget_shuffles(spark)
    rules = _rules(state, heavy)
    often = _HeavyPairs(state, rules)
    current, samples = _sample(state, rules, None, 0), []
    for number in range(1, BURN_IN + SAMPLES + 1):
        after = new_folder(spark, "lm-seats")
        _sweep(state, buckets, rules, current, number, number > BURN_IN + 1).write.parquet(after)
        discard(spark, path)
        path, state = after, spark.read.schema(STATE).parquet(after)
        forget_shuffles(spark)
        current = _sample(state, rules, current, number)
        if number > BURN_IN:
            samples.append(current)
            often.sampled(state)

    heavy_words, heavy_contexts, heavy_counts, heavy_logs = often.scored(state, samples)

    heavy_at = _bucket(heavy_words, heavy_contexts, heavy, buckets)
    names = ["bucket", "slice", "words", "sizes", "heads", "contexts", "docs", "own"]

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        place = context.partitionId() << 32
        for number, tokens in enumerate(_slices(batches)):
            words, contexts, doc, edges, hashes = tokens.dealt(heavy, buckets)
            at = np.full(len(words), -1)
            for i in range(len(heavy_words)):
                first, last = edges[heavy_at[i]], edges[heavy_at[i] + 1]
                begin, end = (first + np.searchsorted(words[first:last], heavy_words[i], side) for side in ("left", "right"))
                places = (np.searchsorted(hashes, heavy_contexts[i], side) for side in ("left", "right"))
                lo, hi = (begin + np.searchsorted(contexts[begin:end], x) for x in places)
                at[lo:hi] = i
            found = at >= 0
            n = len(tokens.sizes)
            score = np.bincount(doc[found], weights=heavy_logs[at[found]], minlength=n)
            base = np.bincount(doc[found], weights=np.log10(heavy_counts[at[found]] + 1.0), minlength=n)
            known = np.bincount(doc[found], minlength=n)
            ids = np.array([-1 if x is None else x for x in tokens.ids], dtype=np.int64)
            out = [
                {
                    "bucket": -1,
                    "slice": place + number,
                    "heads": None,
                    "own": None,
                    "words": ids.tobytes(),
                    "sizes": np.array([x is None for x in tokens.ids]).tobytes() + np.array(tokens.flags).tobytes() + pack(np.array(tokens.sizes)),
                    "contexts": score.tobytes(),
                    "docs": base.tobytes() + known.astype(np.int64).tobytes(),
                }
            ]
            for b in range(buckets):
                rest = edges[b] + np.flatnonzero(~found[edges[b] : edges[b + 1]])
                if len(rest):
                    block = dict(zip(("words", "sizes", "heads", "contexts"), _block(words[rest], contexts[rest], hashes), strict=True))
                    out.append({"bucket": b, "slice": place + number, "docs": pack(doc[rest]), "own": None, **block})
            yield pd.DataFrame(out, columns=names)

    def judge(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        predictive, out = None, []
        sums = part[part["slice"] < 0]
        if len(own):
            row = own.to_dict("records")[0]
            predictive = Predictive(row, _all_totals(row, (-1 - sums["slice"]).tolist(), sums["own"].tolist()), rules, samples)
        for r in part[part["slice"] >= 0].drop(columns="own").to_dict("records"):
            if r["bucket"] < 0:
                out.append({"slice": r["slice"], "docs": None, "n": r["sizes"], "score": r["contexts"], "base": r["words"] + r["docs"]})
                continue
            logs, count = predictive.score(*_pairs(r))
            doc = unpack(r["docs"])
            present, at = np.unique(doc, return_inverse=True)
            out.append(
                {
                    "slice": r["slice"],
                    "docs": pack(present),
                    "n": pack(np.bincount(at[count > 0], minlength=len(present))),
                    "score": np.bincount(at, weights=logs).tobytes(),
                    "base": np.bincount(at, weights=np.log10(count + 1.0)).tobytes(),
                }
            )
        return pd.DataFrame(out, columns=["slice", "docs", "n", "score", "base"])

    per_token = np.log10(rules.tokens + rules.words + 1.0)
    train_tokens = rules.tokens

    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        head = part[part["docs"].isna()].iloc[0]
        ids = np.frombuffer(head["base"], dtype=np.int64)
        n = len(head["score"]) // 8
        ids, rest = ids[:n], head["base"][8 * n :]
        score = np.frombuffer(head["score"]).copy()
        base = np.frombuffer(rest[: 8 * n]).copy()
        known = np.frombuffer(rest[8 * n :], dtype=np.int64).copy()
        empty, held = np.frombuffer(head["n"][:n], dtype=bool), np.frombuffer(head["n"][n : 2 * n], dtype=bool)
        tokens = unpack(head["n"][2 * n :]).astype(np.int64)
        for r in part[part["docs"].notna()].to_dict("records"):
            at = unpack(r["docs"])
            score[at] += np.frombuffer(r["score"])
            base[at] += np.frombuffer(r["base"])
            known[at] += unpack(r["n"])
        return pd.DataFrame(
            {
                "id": pd.array(ids, dtype="Int64").copy() if not empty.any() else pd.Series([None if e else i for i, e in zip(ids.tolist(), empty, strict=True)], dtype="Int64"),
                "held_out": held,
                "n_tokens": tokens,
                "n_known": known,
                "base_score": base - tokens * per_token,
                "score": score,
            }
        )

    none = [F.lit(None).cast("binary").alias(c) for c in ("words", "sizes", "heads", "contexts", "docs")]
    totals = _context_totals(state, buckets).select("bucket", (-1 - F.col("place").cast("long")).alias("slice"), *none, "own")
    totals = settled(totals, "lm-totals")
    forget_shuffles(spark)
    own = state.select(*FIXED, "tables", "parents", "totals", "own")
    # header rows have no bucket of their own: any place will do
    place = F.when(F.col("bucket") < 0, -1 - F.pmod("slice", F.lit(buckets))).otherwise(F.col("bucket")).cast("int").alias("place")
    rounds = max(1, min(ROUNDS, size // ROUND_BYTES))
    scored = new_folder(spark, "lm-scores")
    for number in range(rounds):
        mine = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == number) if rounds > 1 else rows
        sent = mine.mapInPandas(events, EVENTS).unionAll(totals)
        parts = sent.withColumn("place", place).groupBy("place").cogroup(own.withColumnRenamed("bucket", "place").groupBy("place"))
        parts.applyInPandas(judge, PARTS).groupBy("slice").applyInPandas(add_up, SCORES).write.mode("append").parquet(scored)
        del sent, parts
        forget_shuffles(spark)
    discard(spark, path)
    return spark.read.schema(SCORES).parquet(scored).select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


class _HeavyPairs:
    """The at most 1 / HEAVY_SHARE pairs with that share of all training tokens,
    which are scored where the texts are read; their contexts' totals are a few
    numbers at the driver."""

    def __init__(self, state: DataFrame, rules: Rules):
        self.rules, least = rules, max(1, int(np.ceil(rules.tokens * HEAVY_SHARE)))

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    words, contexts = _pairs(r)
                    often = unpack(r["counts"]) >= least
                    yield pd.DataFrame({"word": words[often].view(np.int64), "context": contexts[often].view(np.int64)})

        found = state.select(*FIXED).mapInPandas(pick, "word long, context long").collect()
        pairs = sorted((r["word"] % (1 << 64), r["context"] % (1 << 64)) for r in found)
        self.words, self.contexts = (np.array([x[i] for x in pairs], dtype=np.uint64) for i in (0, 1))
        self.totals = self._of_contexts(state)[:1]

    def _of_contexts(self, state: DataFrame) -> list[np.ndarray]:
        wanted = np.unique(self.contexts)

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    at, found = _find(unpack(r["heads"]).astype(np.uint64), wanted)
                    n = [np.where(found, unpack(x)[at], 0).astype(np.int64).tolist() for x in r["own"]]
                    yield pd.DataFrame({"own": [sum(n, [])]})

        sums = _sums(state.select("heads", "own").mapInPandas(own, "own array<long>"), "own", 2 * len(wanted))
        return [x[np.searchsorted(wanted, self.contexts)] for x in sums.reshape(2, -1)]

    def sampled(self, state: DataFrame) -> None:
        """Tables of the contexts after a sweep that counts."""
        self.totals.append(self._of_contexts(state)[0])

    def scored(self, state: DataFrame, samples: list[Sample]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and contexts, ascending; training counts of the words, and log10
        probabilities."""
        rules, words, contexts, totals = self.rules, self.words, self.contexts, self.totals

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    heads = unpack(r["heads"]).astype(np.uint64)
                    at, found = _find(heads, contexts)
                    known = _find(unpack(r["words"]).astype(np.uint64), words)[1] & found
                    out = []
                    if known.any():
                        per_head = [np.zeros(len(heads)) for _ in totals]
                        for x, own in zip(per_head, totals, strict=True):
                            x[at[known]] = own[known]
                        model = Predictive(r, per_head, rules, samples)
                        for i in np.flatnonzero(known):
                            logs, n = model.score(words[i : i + 1], contexts[i : i + 1]) if model.holds(words[i], contexts[i]) else ([], [])
                            out += [(int(i), int(b), float(a)) for a, b in zip(logs, n, strict=True)]
                    yield pd.DataFrame(out, columns=["i", "n", "log"])

        own = state.select(*FIXED, "tables", "parents")
        found = {r["i"]: r for r in own.mapInPandas(pick, "i long, n long, log double").collect()}
        counts = np.array([found[i]["n"] for i in range(len(words))], dtype=np.int64)
        return words, contexts, counts, np.array([found[i]["log"] for i in range(len(words))], dtype=float)
