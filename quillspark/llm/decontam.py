"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search. A document is a set of shingles of five words, and
documents are partitioned by the size of that set, to powers of two. A partition whose largest
set has u shingles uses a one-permutation MinHash signature of u bins: a bin holds the smallest
hash that falls into it, so a signature has 63 to 79 % as many hashes as the set. Its length follows
the partition's size, as the Jaccard similarity that a given containment leaves falls with it. An
item is hashed into the bins of each partition; it is a candidate of a document if they agree in a
bin. A shingle that both have is the document's smallest in its bin with probability 0.63 or more,
so an item of 16 shingles or more that is contained to 0.8 is missed with probability 0.37**13 (three
in a million) or less; items of fewer shingles are looked up by every shingle. Candidates are
verified exactly, on the words themselves.

Items are sent to the executors in blocks of a bounded number of words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, new_path, written

WORDS = 5
CONTAINMENT = 0.8
FEW = 16
BINS = 1
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall((text or "").lower())


#: Words are hashed in pieces of so many.
PIECE = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, base, np.uint64)], dtype=np.uint64)
    return _POWERS


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words without spaces: differences of one running sum over their bytes, each
    moved to the same power."""
    out = [np.empty(0, np.uint64)]
    for at in range(0, len(words), PIECE):
        data = np.frombuffer(" ".join(words[at : at + PIECE]).encode(), np.uint8)
        up, down = _powers(len(data) + 1)
        total = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)]
        ends = np.r_[np.flatnonzero(data == 32), len(data)]
        starts = np.r_[0, ends[:-1] + 1]
        h = (total[ends] - total[starts]) * down[starts]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        out.append(h ^ h >> np.uint64(29))
    return np.concatenate(out)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, from the words' hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ hashes[j : len(hashes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Items:
    """A block of items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.words = words
        self.ids, self.sets = [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.hashes: list[np.ndarray] = []
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            n = min(words, len(w))
            at = len(self.ids)
            self.ids.append(item_id)
            self.sets.append((n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}))
            h = np.unique(shingle_hashes(word_hashes(w), n))
            self.hashes.append(h)
            if n < words or len(h) < FEW:
                for x in h.tolist():
                    self.short[n][x].append(at)
        self.short = {n: dict(d) for n, d in self.short.items()}
        self.tables: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}

    def table(self, bits: int) -> tuple[np.ndarray, dict[int, list[int]]]:
        """The items' smallest hashes in 2**bits bins, sorted, and whose they are."""
        if bits not in self.tables:
            owners: dict[int, list[int]] = defaultdict(list)
            for at, h in enumerate(self.hashes):
                if self.sets[at][0] == self.words and len(h) >= FEW:
                    for x in smallest(h, bits).tolist():
                        owners[x].append(at)
            for x, who in self.short.get(self.words, {}).items():
                owners[x] = owners.get(x, []) + who
            self.tables[bits] = np.array(sorted(owners), np.uint64), dict(owners)
        return self.tables[bits]


def smallest(h: np.ndarray, bits: int) -> np.ndarray:
    """The smallest of the sorted hashes in each of 2**bits bins."""
    bins = h >> np.uint64(64 - bits)
    first = np.ones(len(h), bool)
    first[1:] = bins[1:] != bins[:-1]
    return h[first]


def common(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Values that are in both sorted arrays."""
    if len(few) > len(many):
        few, many = many, few
    if not len(few):
        return few
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return few[many[at] == few]


def contained(text: str | None, items: Items, least: float) -> list[tuple[int, int, int]]:
    """(item's number, its shingles, those in the text) of the items that the text contains."""
    w = words_of(text)
    if not w or not items.ids:
        return []
    hashes = word_hashes(w)
    found: set[int] = set()
    for n in {items.words, *items.short}:
        h = np.unique(shingle_hashes(hashes, n))
        if not len(h):
            continue
        if n == items.words:
            bits = int(BINS * len(h)).bit_length()  # the partition's bound is a power of two
            keys, owners = items.table(bits)
            sig = smallest(h, bits)
            hits = common(keys, sig).tolist()
            if n in items.short:
                hits += common(np.array(sorted(items.short[n]), np.uint64), h).tolist()
        else:
            owners = items.short[n]
            hits = common(np.array(sorted(owners), np.uint64), h).tolist()
        for x in hits:
            found.update(owners[x])
    out, sets = [], {}
    for at in sorted(found):
        n, shingles = items.sets[at]
        if n not in sets:
            sets[n] = set(zip(*(w[j:] for j in range(n))))
        shared = len(shingles & sets[n])
        if shared >= least * len(shingles):
            out.append((at, len(shingles), shared))
    return out


def _search(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        ids = batch.column("doc_id")
        for i, text in enumerate(batch.column("text")):
            rows += [(i, items.ids[at], n, shared) for at, n, shared in contained(text.as_py(), items, least)]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "n_shingles", "n_shared"])


def _clean(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not contained(t.as_py(), items, least) for t in batch.column("text")], pa.bool_()))


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``block_words`` words; one list, maybe empty, at least."""
    # a repeated item may fill a block; rows of one item are dealt by number
    items = benchmark.where(F.col("text") != "").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 4
    blocks = max(1, math.ceil(total / block_words))
    if blocks > 1:
        items, _ = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(blocks))), "items")
    for b in range(blocks):
        rows = items.where(F.col("block") == b) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in rows.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = CONTAINMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for every document that holds at least
    ``least`` of an item's distinct shingles.

    Words are runs of letters and digits of the lower-cased text. An item of fewer words than a
    shingle is one shingle of all its words. Items and documents that are null or have no word
    match nothing; a null item_id or doc_id stays null. Repeated rows of either table each count,
    so a pair may repeat. Further columns are ignored. Runs actions on ``benchmark``.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, n_shingles long, n_shared long"

    def search(rows: list[tuple[int, str]]) -> DataFrame:
        block = Items(rows, words)
        return docs.select("doc_id", "text").mapInArrow(lambda it: _search(it, block, least), schema)

    blocks = _blocks(benchmark, block_words)
    found, rest = search(next(blocks)), next(blocks, None)
    if rest is not None:
        # one block at a time is in memory, so each is searched before the next is read
        out = new_path(spark, "contained")
        found.write.parquet(out)
        while rest is not None:
            search(rest).write.mode("append").parquet(out)
            rest = next(blocks, None)
        found = spark.read.schema(schema).parquet(out)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = CONTAINMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, whole, that contain no item by ``least`` or more; edge cases are as in
    :func:`contaminated`. Nothing is shuffled. Of several blocks each is searched, and what is clean
    written, before the next one is read."""
    schema, path = docs.schema, None
    blocks = _blocks(benchmark, block_words)
    rows = next(blocks)
    while rows is not None:
        block = Items(rows, words)
        rows = next(blocks, None)
        clean = docs.mapInArrow(lambda it, block=block: _clean(it, block, least), schema)
        if rows is None:
            return clean
        before = path
        docs, path = written(clean, "clean")
        if before:
            dropped(docs.sparkSession, before)
    return docs
