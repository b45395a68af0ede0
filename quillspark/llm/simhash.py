"""SimHash near-duplicates by anchor-point covering.

A fingerprint is 64 bits. The anchors are the words of a covering code, the direct sum of two
binary Golay codes on 23 bits (covering radius 3 each), the Hamming code on 15 bits (radius 1)
and all words on the last 3 bits (radius 0): 2**38 anchors, radius 7 in all. All four are perfect
codes, so each 64-bit word has one home anchor, found by syndrome.

Two fingerprints that differ in t bits have a midpoint within ceil(t / 2) of both, and that
point's home anchor is within the covering radius of it. So it is enough to copy a fingerprint to
the home of every word within reach = ceil(t / 2) of it, which are anchors within covering radius
plus reach; a pair at distance t or less always meets at one of them, where it is compared. For
t = 2 that is about 21 copies; the full radius plus t would take about 230 and find the same pairs.

Anchors with up to ``CELL`` distinct fingerprints are compared at once. A larger one is split by
the word within reach (the midpoint) instead: for reach 1 at most 65 distinct fingerprints share a
midpoint, and any two of them differ in 2 bits at most, so there is no group without bound and no
list of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .decontam import shingle_hashes, word_hashes
from .skew import split_join
from .store import cut, dropped, unused, written

SEED = 42
CELL = 64
GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int) -> int:
    """Lower-cases A-Z, hashes the shingles of so many words with XXH64 (seed 42), repeats
    included; a bit is set if it is in more than half of the hashes. Fewer words make one
    shingle; no word gives 0."""
    w = (text or b"").lower().split()  # splits at space and 0x09 to 0x0D
    if not w:
        return 0
    joined = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(w) > words:
        starts, ends = starts[: len(w) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    pieces = (np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], dtype="<u8") for at in range(0, len(starts), CHUNK))
    return majority(pieces, len(starts))


def majority(pieces: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in more than half of n hashes."""
    ones = np.zeros(64, np.int64)
    for h in pieces:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        out = np.fromiter((fingerprint(x.as_py(), words) for x in text), np.uint64, len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint ``fp`` as a signed long, one row a row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, words), f"doc_id {kind}, fp long")


def _golay_errors() -> np.ndarray:
    """Error pattern of each of the 2**11 syndromes of the Golay code: all words of weight 3 or less."""
    bits = [0] + [1 << i for i in range(23)]
    words = np.array(sorted({a | b | c for a in bits for b in bits for c in bits}), np.uint64)
    table = np.zeros(2048, np.uint64)
    table[_golay_syndrome(words)] = words
    return table


def _golay_syndrome(w: np.ndarray) -> np.ndarray:
    w = w.copy()
    for i in range(22, 10, -1):
        w ^= np.where(w >> np.uint64(i) & np.uint64(1), np.uint64(GOLAY << (i - 11)), np.uint64(0))
    return w.astype(np.int64)


def _hamming_syndrome(w: np.ndarray) -> np.ndarray:
    s = np.zeros(w.shape, np.int64)
    for i in range(15):
        s ^= np.where(w >> np.uint64(i) & np.uint64(1), i + 1, 0)
    return s


ERRORS = _golay_errors()
#: Syndromes of all 23-bit words would need a large table; they are linear, so two small ones do.
LOW, HIGH = _golay_syndrome(np.arange(1 << 12, dtype=np.uint64)), _golay_syndrome(np.arange(1 << 11, dtype=np.uint64) << np.uint64(12))
HAMMING = np.array([0] + [1 << i for i in range(15)], np.uint64)
HAMMING_OF = _hamming_syndrome(np.arange(1 << 15, dtype=np.uint64))


def home(x: np.ndarray) -> np.ndarray:
    """The anchor whose cell holds each 64-bit word: the nearest codeword in each part."""
    u = np.uint64
    a, b, c = x & u(0x7FFFFF), x >> u(23) & u(0x7FFFFF), x >> u(46) & u(0x7FFF)
    fix = lambda w: ERRORS[LOW[w & u(0xFFF)] ^ HIGH[w >> u(12)]]
    return x ^ fix(a) ^ (fix(b) << u(23)) ^ (HAMMING[HAMMING_OF[c]] << u(46))


def near(x: np.ndarray, reach: int, bits: int = 64) -> np.ndarray:
    """All words of so many bits within ``reach`` bits of each word, one row a word."""
    masks = {0}
    for _ in range(reach):
        masks |= {m ^ (1 << i) for m in masks for i in range(bits)}
    masks = {m for m in masks if m.bit_count() <= reach}
    return x[:, None] ^ np.array(sorted(masks), np.uint64)[None, :]


def _pairs(family: np.ndarray, left: np.ndarray, right: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(family, pa.int32()), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["s", *names])


def _to_anchors(batches: Iterator[pa.RecordBatch], reach: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, s = batch.column("fp").to_numpy().view(np.uint64), batch.column("s").to_numpy()
        for at in range(0, len(fp), 4096):
            x = fp[at : at + 4096]
            anchors = np.sort(home(near(x, reach, bits)), axis=1)
            new = np.ones(anchors.shape, bool)
            new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
            copies = new.sum(axis=1)
            yield _pairs(np.repeat(s[at : at + 4096], copies), anchors[new], np.repeat(x, copies), ["anchor", "fp"])


def _to_midpoints(batches: Iterator[pa.RecordBatch], reach: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("anchor", "fp"))
        s = batch.column("s").to_numpy()
        for at in range(0, len(fp), 4096):
            x = fp[at : at + 4096]
            points = near(x, reach, bits)
            own = home(points) == anchor[at : at + 4096, None]
            copies = own.sum(axis=1)
            yield _pairs(np.repeat(s[at : at + 4096], copies), points[own], np.repeat(x, copies), ["anchor", "fp"])


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of each list ``fps`` as a star for each of its components."""
    for batch in batches:
        lists, s = batch.column("fps"), batch.column("s").to_numpy()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        sizes = np.diff(offsets)
        for n in np.unique(sizes[sizes > 1]):
            for rows in np.array_split(np.flatnonzero(sizes == n), max(1, int((sizes == n).sum() * n * n // 2_000_000))):
                x = np.sort(flat[offsets[rows][:, None] + np.arange(n)], axis=1)
                linked = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= distance
                label = np.broadcast_to(np.arange(n), x.shape)
                while True:
                    new = np.where(linked, label[:, None, :], n).min(axis=2)
                    if (new == label).all():
                        break
                    label = new
                g, i = np.nonzero(label != np.arange(n))
                yield _pairs(s[rows][g], x[g, label[g, i]], x[g, i], ["u", "v"])


def links(fps: DataFrame, distance: int = 2, cell: int = CELL, bits: int = 64) -> DataFrame:
    """Edges (s, u, v) between distinct fingerprints whose components are those of all pairs that
    differ in ``distance`` bits or fewer. ``fps`` has distinct rows of s (int: which family of
    fingerprints; only those of one family are compared) and fp (long, of ``bits`` bits), without
    nulls."""
    reach = (distance + 1) // 2
    rows = fps.select("s", "fp").mapInArrow(lambda it: _to_anchors(it, reach, bits), "s int, anchor long, fp long")
    counts = rows.groupBy("s", "anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(rows.join(counts, ["s", "anchor"]), "anchors")
    lists = lambda df: df.groupBy("s", "anchor").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("s", "fps")
    small = lists(shared.where(F.col("n") <= cell))
    large = shared.where(F.col("n") > cell).select("s", "anchor", "fp")
    large = lists(large.mapInArrow(lambda it: _to_midpoints(it, reach, bits), "s int, anchor long, fp long"))
    return small.unionByName(large).mapInArrow(lambda it: _compare(it, distance), "s int, u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row a row of ``docs``.

    Documents whose fingerprints differ in ``distance`` bits or fewer are linked; component_id is
    the smallest doc_id reachable. Texts that are null, empty or without a word have fingerprint
    zero and are linked like any other. Rows with a null doc_id are linked too, but name no
    component; repeated rows stay. Further columns are ignored. Empty table: no rows. Runs actions.
    Fingerprints of many rows and components of many fingerprints are joined where their rows are.
    """
    fps = cut(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    tree = components(links(nodes.withColumn("s", F.lit(0)), distance).select("u", "v"))
    member = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    member, at = written(member, "members")
    names, names_at = written(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "components")
    named = cut(split_join(member, names, ["root"], "size", member.count()).select("fp", "n", "component_id"), "named")
    dropped(docs.sparkSession, at, names_at)
    return split_join(fps, named, ["fp"], "n", fps.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For texts that are similar without being nearly equal: words of a shingle, similarity, hashes of
#: a sketch, and by how much a sketch may err (seven standard deviations: one pair in 10**11).
SHINGLE = 5
SIMILARITY = 0.8
SKETCH = 128
SLACK = 0.25
#: Shingles that are broadcast with their counts, at most; characters of the texts for each task that
#: counts, ranges of hashes for each, and hashes that are gathered before they are dealt out by range.
COMMON = 1 << 17
COUNTED = 1 << 24
RANGES = 16
DEALT = 1 << 20
#: Words of 64 bits in the bitmap of a set of shingles.
BITMAP = 8


def _shingles(text: str | None, n: int) -> np.ndarray:
    w = (text or "").lower().split()
    return np.unique(shingle_hashes(word_hashes(w), min(n, len(w)))) if w else np.empty(0, np.uint64)


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the values, cut at these starts."""
    offsets = np.append(starts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _listed(batches: Iterator[pa.RecordBatch], shingle: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Shingles and in how many of the texts gathered they are, a row for each range of hashes."""
    held, size = [], 0

    def listed() -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(found), DEALT):
            h, n = found[at : at + DEALT].astype("<u8"), counts[at : at + DEALT].astype("<u4")
            part = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), _slices(h, starts), _slices(n, starts)], ["part", "h", "n"])

    for batch in batches:
        for text in batch.column("text"):
            held.append(_shingles(text.as_py(), shingle))
            size += len(held[-1])
            if size >= DEALT:
                yield from listed()
                held, size = [], 0
    if size:
        yield from listed()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of a task's ranges that are in three or more texts, and in how many."""
    rows = [(h.as_py(), n.as_py()) for batch in batches for h, n in zip(batch.column("h"), batch.column("n"))]
    h, n = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*rows), ("<u8", "<u4"))) if rows else (np.empty(0, np.uint64), np.empty(0, np.uint32))
    order = np.argsort(h)
    h, n = h[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    sums = np.add.reduceat(n, starts) if len(h) else n
    often = sums > 2
    h, n = h[starts][often], sums[often]
    for at in range(0, len(h), GATHERED):
        yield pa.RecordBatch.from_arrays([pa.array(h[at : at + GATHERED].view(np.int64)), pa.array(n[at : at + GATHERED])], ["h", "n"])


def common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and in how many of the rows they are, counted over all: those in m rows or
    more, for the least m from 3 on that leaves ``COMMON`` or fewer. They only say in which order
    shingles are taken, so pairs that share one in less than m rows are found like any other.

    Hashes are dealt out by range, in arrays, so no row is one shingle and none of a shingle that is
    in many texts has more than one entry in each array."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // COUNTED))
    parts = rows.select("text").mapInArrow(lambda it: _listed(it, shingle, RANGES * tasks), "part int, h binary, n binary")
    counts, at = written(parts.repartition(tasks, "part").mapInArrow(_counted, "h long, n long"), "counts")
    least, kept = 3, 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("shingles")).collect(), reverse=True):
        kept += r.shingles
        if kept > COMMON:
            least = r.n + 1
            break
    top = counts.where(F.col("n") >= least).toPandas().to_numpy(np.int64).reshape(-1, 2)
    dropped(spark, at)
    h = top[:, 0].copy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top[order, 1]


def prefix(shingles: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a text's shingles in an order that is the same for all texts, rare ones before
    common ones: so many that two sets of similarity ``least`` or more have one in common. Such sets
    share least * n of the n shingles of either; the others are fewer than what is taken here."""
    n = len(shingles)
    known, counts = common
    weight = np.zeros(n, np.int64)
    if n and len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        weight = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, weight))][: n - math.ceil(least * n - 1e-9) + 1]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """64 * BITMAP parities: bit i says whether an odd number of the shingles falls to it. A shingle
    that only one of two sets has changes one bit, so the bitmaps of two sets differ in no more bits
    than the sets in shingles."""
    at = (shingles >> np.uint64(17)).astype(np.int64) % (64 * BITMAP)
    odd = np.bincount(at, minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _described(batches: Iterator[pa.RecordBatch], shingle: int, least: float, sketch: int, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The 128-bit hash of a text's set of shingles, how many there are, the prefix, the least hashes,
    the bitmap and the fingerprint of these."""
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            h = _shingles(text, shingle)
            digest = xxhash.xxh3_128_digest(h.tobytes())
            fp = np.uint64(majority((h[at : at + CHUNK].astype("<u8") for at in range(0, len(h), CHUNK)), len(h)))
            first = prefix(h, least, common).astype("<u8").tobytes()
            out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), len(h), first, np.unique(h >> np.uint64(32))[:sketch].astype("<u4").tobytes(), bitmap(h).tobytes(), fp.view(np.int64).item()))
        cols = list(zip(*out)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*kept, "t1", "t2", "n", "prefix", "sketch", "bits", "fp"])


#: Rows that are gathered before they are handed on.
GATHERED = 1 << 18


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix, with its place there, and the other columns. Texts without
    a word share one key."""
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "prefix"]
        first = [np.frombuffer(x.as_py(), "<i8") if n else np.zeros(1, np.int64) for x, n in zip(batch.column("prefix"), batch.column("n").to_pylist())]
        sizes = np.array([len(x) for x in first], np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GATHERED, "right")))
            row = pa.array(np.repeat(np.arange(at, to), sizes[at:to]))
            place = np.arange(int(sizes[at:to].sum())) - np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first[at:to])), *(batch.column(c).take(row) for c in kept), pa.array(place)], ["key", *kept, "at"])
            at = to


def _may_pair(n: np.ndarray, at: np.ndarray, n2: np.ndarray, at2: np.ndarray, least: float) -> np.ndarray:
    """Whether sets whose first common shingle is at these places can be similar enough."""
    return np.minimum(n - at, n2 - at2) * (1 + least) >= least * (n + n2) - 1e-6


def _members(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The members of each group by size: node, n, at and, where the batch has them, root and bits."""
    lists = batch.column("members")
    offsets, values = lists.offsets.to_numpy(), lists.values
    cols = [np.frombuffer(b"".join(values.field(i).to_pylist()), "<u8").reshape(-1, BITMAP) if values.type.field(i).name == "bits" else values.field(i).to_numpy() for i in range(values.type.num_fields)]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        order = np.lexsort((cols[0][a:b], cols[1][a:b]))
        yield tuple(c[a:b][order] for c in cols)


def _uv(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (u, v))
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])


def _stars(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each group, pairs of a hub and the members that are no more than 1 / least its size; what
    is larger has a hub of its own."""
    for batch in batches:
        u, v = [], []
        for node, n, at in _members(batch):
            i = 0
            while i < len(n):
                j = int(np.searchsorted(n, n[i] / least + 1e-6, "right"))
                ok = _may_pair(n[i], at[i], n[i + 1 : j], at[i + 1 : j], least)
                v.append(node[i + 1 : j][ok])
                u.append(np.full(len(v[-1]), node[i]))
                i = j
        yield _uv(u, v)


def _close(i: int, others: np.ndarray | slice, n: np.ndarray, at: np.ndarray, root: np.ndarray, bits: np.ndarray, least: float) -> np.ndarray:
    """Which of the others may be similar enough to member i, and have another root. Sets of a and b
    shingles that share least of all differ in no more than (a + b) * (1 - least) / (1 + least)."""
    ok = _may_pair(n[i], at[i], n[others], at[others], least) & (root[others] != root[i])
    if ok.any():
        some = np.flatnonzero(ok)
        apart = np.bitwise_count(bits[others][some] ^ bits[i]).sum(axis=1)
        ok[some] = apart * (1 + least) <= (n[i] + n[others][some]) * (1 - least) + 1e-6
    return ok


#: Hubs of a group in one round, rounds at most before all that is left is compared, and members from
#: which a group has hubs: of fewer, every two are compared at once.
HUBS = 4
ROUNDS = 6
LARGE = 32


def _hubs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each group, pairs of a member of each of its largest components and members of others."""
    for batch in batches:
        u, v = [], []
        for node, n, at, root, bits in _members(batch):
            roots, counts = np.unique(root, return_counts=True)
            for r in roots[np.lexsort((roots, -counts))][:HUBS]:
                own = np.flatnonzero(root == r)
                i = int(own[len(own) // 2])
                found = node[_close(i, slice(None), n, at, root, bits, least)]
                v.append(found)
                u.append(np.full(len(found), node[i]))
        yield _uv(u, v)


def _across(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """All pairs of each group that may be similar enough and have different roots."""
    for batch in batches:
        u, v, held = [], [], 0
        for node, n, at, root, bits in _members(batch):
            for i, j in enumerate(np.searchsorted(n, n / least + 1e-6, "right").tolist()):
                found = node[i + 1 : j][_close(i, slice(i + 1, j), n, at, root, bits, least)]
                if len(found):
                    v.append(found)
                    u.append(np.full(len(found), node[i]))
                    held += len(found)
                if held > GATHERED:
                    yield _uv(u, v)
                    u, v, held = [], [], 0
        yield _uv(u, v)


def resemblance(a: bytes, b: bytes, sketch: int = SKETCH) -> float:
    """Jaccard similarity of two sets of shingles by their least hashes: exact for sets that are
    whole in their sketches. Two empty sets are equal."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    least = np.union1d(x, y)[:sketch] if max(len(x), len(y)) == sketch else np.union1d(x, y)
    return float(np.isin(least, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean()) if len(least) else 1.0


def _verified(batches: Iterator[pa.RecordBatch], least: float, sketch: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar enough, and, with ``whole`` false, those whose sketches can't tell."""
    for batch in batches:
        whole = [max(len(a.as_py()), len(b.as_py())) < 4 * sketch for a, b in zip(batch.column("left"), batch.column("right"))]
        ok = [resemblance(a.as_py(), b.as_py(), sketch) >= (least if w else least - SLACK) for a, b, w in zip(batch.column("left"), batch.column("right"), whole)]
        out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(whole, pa.bool_())], ["u", "v", "whole"])
        yield out.filter(pa.array(ok, pa.bool_()))


def _exact(batches: Iterator[pa.RecordBatch], shingle: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for a, b in zip(batch.column("left"), batch.column("right")):
            x, y = (_shingles(t.as_py(), shingle) for t in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(shared >= least * (len(x) + len(y) - shared))
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, sketch: int = SKETCH, distance: int = 2) -> DataFrame:
    """``docs`` without near copies: of each group only the row with the smallest doc_id stays.

    Groups are the components of verified links. Texts are linked if the Jaccard similarity of their
    sets of shingles of five words is ``least`` or more; every pair is checked exactly, by sketches
    of the ``sketch`` least hashes where these hold the whole sets, else by the texts.

    Candidates come in rounds. First, texts whose SimHash fingerprints differ in ``distance``
    bits or fewer, found at the anchors, and of the texts that share one of their first shingles
    (``prefix``) a hub of about their size with each. Then members of the largest components among
    those that share a shingle with all that aren't in theirs yet, again as long as that finds links;
    at last every two that share one, are in different components still, and that their bitmaps
    don't rule out. Any similar pair shares such a shingle, however the texts differ, and bitmaps
    bound the difference from below, so no link between different components is lost.

    Texts with equal sets of shingles are one group, so are all texts without a word (null among
    them). A null doc_id is the greatest. All columns are kept. Empty table: no rows. Runs actions.
    """
    spark = docs.sparkSession
    rid = unused("_rid", docs.columns)
    rows, _ = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = rows.select(F.col(rid).alias("rid"), "doc_id", "text")
    common = common_shingles(slim, shingle)
    described = slim.mapInArrow(lambda it: _described(it, shingle, least, sketch, common), f"rid long, doc_id {kind}, t1 long, t2 long, n long, prefix binary, sketch binary, bits binary, fp long")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    nodes = described.groupBy("t1", "t2").agg(best.alias("best"), *(F.first(c).alias(c) for c in ("n", "prefix", "sketch", "bits", "fp")))
    nodes, nodes_at = written(nodes.withColumn("node", F.col("best.rid")), "nodes")
    keys = nodes.select("node", "n", "prefix").mapInArrow(_keys, "key long, node long, n long, at long")
    groups, groups_at = written(keys.groupBy("key").agg(F.collect_list(F.struct("node", "n", "at")).alias("members")).where(F.size("members") > 1), "groups")
    stars = groups.select("members").mapInArrow(lambda it: _stars(it, least), "u long, v long")
    texts = slim.select(F.col("rid").alias("node"), F.col("text").alias("x"))
    stars, stars_at = written(stars.unionByName(_fingerprint_pairs(nodes.select("node", "fp"), distance)).distinct(), "pairs")

    def with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Pairs with what ``of`` (node, x) has of either side; of it, only what they name is dealt out."""
        named = of.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
        end = lambda node, name: named.select(F.col("node").alias(node), F.col("x").alias(name))
        return pairs.join(end("u", "left"), "u").join(end("v", "right"), "v").select("u", "v", "left", "right")

    def verified(pairs: DataFrame) -> DataFrame:
        sketched = with_both(pairs, nodes.select("node", F.col("sketch").alias("x"))).mapInArrow(lambda it: _verified(it, least, sketch), "u long, v long, whole boolean")
        sketched = cut(sketched, "sketched")
        unsure = sketched.where("NOT whole").select("u", "v")
        exact = with_both(unsure, texts).mapInArrow(lambda it: _exact(it, shingle, least), "u long, v long")
        return cut(sketched.where("whole").select("u", "v").unionByName(exact), "links")

    def dealt(of: DataFrame) -> tuple[DataFrame, str]:
        """What later rounds need, joined to texts before it is dealt out to the keys they share."""
        return written(of.select("key", F.inline("members")).groupBy("node").agg(F.collect_list(F.struct("key", "at")).alias("keys")).join(nodes.select("node", "n", "bits"), "node"), "shared")

    def mixed(shared: DataFrame, tree: DataFrame) -> DataFrame:
        """The groups whose members aren't all in one component."""
        rooted = shared.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
        member = rooted.select("node", "n", "root", "bits", F.inline("keys"))
        found = member.groupBy("key").agg(F.collect_list(F.struct("node", "n", "at", "root", "bits")).alias("members"), (F.min("root") < F.max("root")).alias("mixed"))
        return found.where("mixed").select("members")

    def pairs_of(tree: DataFrame) -> DataFrame:
        return tree.select(F.col("node").alias("u"), F.col("root").alias("v"))

    compared = stars
    tree = cut(components(verified(stars)), "trees")
    large, large_at = dealt(groups.where(F.size("members") >= LARGE))
    for _ in range(0 if large.isEmpty() else ROUNDS):
        more = cut(mixed(large, tree).mapInArrow(lambda it: _hubs(it, least), "u long, v long").distinct().join(compared, ["u", "v"], "left_anti"), "pairs")
        found = verified(more)
        if found.isEmpty():
            break
        compared = compared.unionByName(more)
        tree = cut(components(pairs_of(tree).unionByName(found)), "trees")
    shared, shared_at = dealt(groups)
    rest = cut(mixed(shared, tree).mapInArrow(lambda it: _across(it, least), "u long, v long").distinct().join(compared, ["u", "v"], "left_anti"), "pairs")
    tree = components(pairs_of(tree).unionByName(verified(rest)))
    grouped = nodes.join(tree, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    kept = cut(grouped.select(F.col("best.rid").alias(rid)), "kept")
    dropped(spark, nodes_at, groups_at, large_at, shared_at, stars_at)
    return rows.join(kept, rid, "left_semi").drop(rid)


def _fingerprint_pairs(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v) of the texts (node, fp) that share a fingerprint, each with the first of these, and
    of the first ones of two linked fingerprints."""
    first = fps.groupBy("fp").agg(F.min("node").alias("first"))
    same = fps.join(first, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    named = lambda fp, node: first.select(F.col("fp").alias(fp), F.col("first").alias(node))
    near = links(first.select("fp", F.lit(0).alias("s")), distance).select(F.col("u").alias("a"), F.col("v").alias("b")).join(named("a", "x"), "a").join(named("b", "y"), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))
