"""Removal of every byte under a 200-byte string that occurs more than once, by prefix doubling.

A position's rank at length k says which string of k bytes starts there. Ranks at a greater length
come from the pair of ranks at a position and at an offset from it: (rank_k(i), rank_k(i + k)) at
2 k, (rank_k(i), rank_k(i + L - k)) at any L between. Only equality of strings matters here, not
their order, so a rank is a 64-bit name, a hash of its pair, and need not be a place in the order of
all. Spark sorts and groups positions by their ranks at growing lengths. A position drops out when
its rank is unique, as no longer string from there can have a second occurrence, or when what it
stands for is settled past the threshold; the others grow on.

Ranking every position of a corpus would move it many times over (the README has the figures). So a
position stands for those around it, its run: of each 200-byte window the position, among the first
160, whose 8 bytes have the least hash (ties: leftmost). It depends on the window's bytes alone, so
equal windows have it at the same offset, and about one position in 80 is taken. Consecutive windows
of a run, a block, have a core in common and lie in a context:

    blocks of 160 windows: the core is 41 bytes, the context 359
    blocks of  40 windows: core 161, context 239
    blocks of  10 windows: core 191, context 209
    each window alone:     core and context 200

A core that occurs once settles that none of the windows repeats; a context that occurs twice, that
all do. Only the ends of repeated passages go on to the next length, together with one position for
each repeated context of the same core. So the result is exact but for collisions of names: 64 bits
where a position drops out late, 128 bits (core and context, or two names) where bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import split_join
from .store import dropped, written

LENGTH = 200
BLOCKS = (160, 40, 10, 1)
CHUNK = 1 << 20
ROWS = 4096
_U = np.uint64
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_MORE = _U(0xBF58476D1CE4E5B9)
ROW = "rank long, grown long, rid long, p int, lo int, hi int"
NAMES = ["rank", "grown", "rid", "p", "lo", "hi"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _MORE
    return h ^ h >> _U(29)


def pair(left: np.ndarray, right: np.ndarray, kind: int = 0) -> np.ndarray:
    """The rank of a pair of ranks."""
    return mixed(left * _ODD[kind] + right)


def doubled(data: np.ndarray, k: int, kind: int = 0) -> np.ndarray:
    """Ranks at length k, a power of two, of the last axis of an array of bytes: from those of single
    bytes, length after length."""
    rank, n = _BYTES[kind][data], 1
    while n < k:
        rank = pair(rank[..., :-n], rank[..., n:], kind)
        n *= 2
    return rank


def at_length(rank: np.ndarray, k: int, length: int, where: tuple, kind: int = 0) -> np.ndarray:
    """Ranks at a length from k to 2 k, from those at k, of the places ``where`` (the last axis last)."""
    return pair(rank[where], rank[(*where[:-1], where[-1] + (length - k))], kind)


def power(length: int) -> int:
    """The greatest power of two below a length."""
    return 1 << (length - 1).bit_length() - 1


def runs(text: bytes, length: int, core: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Synchronizing positions p with the first and last start of the windows they stand for.

    In pieces; a position whose run goes on in the next piece comes with the later one only.
    """
    width = length - core + 1
    held: tuple[int, int, int] | None = None
    for at in range(0, len(text) - length + 1, CHUNK):
        piece = np.frombuffer(text[at : at + CHUNK + length - 1], np.uint8)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(piece, 8)).view("<u8")[:, 0]
        words = (words ^ words >> _U(31)) * _U(0x9E3779B97F4A7C15)
        words = (words ^ words >> _U(29)) * _MORE
        best = words >> _U(32) << _U(32) | np.arange(len(words), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        n = len(piece) - length + 1
        best = np.minimum(best[:n], best[width - span :][:n])
        where = (best & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        last = np.r_[first[1:] - 1, n - 1]
        p, s1, s2 = where[first] + at, first + at, last + at
        if held is not None:
            if held[0] == p[0]:
                s1[0] = held[1]
            else:
                p, s1, s2 = np.r_[held[0], p], np.r_[held[1], s1], np.r_[held[2], s2]
        held = (int(p[-1]), int(s1[-1]), int(s2[-1]))
        yield p[:-1], s1[:-1], s2[:-1]
    if held is not None:
        yield tuple(np.array([x]) for x in held)


def edge(rid: np.ndarray, p: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Stands for a context that isn't whole: no other position has it."""
    u = lambda x: x.astype(np.int64).view(np.uint64)
    return mixed(mixed(u(rid) * _ODD[0] + u(p)) * _ODD[1] + u(block))


def _ranked(rank: np.ndarray, grown: np.ndarray, *places: np.ndarray) -> pa.RecordBatch:
    rid, *rest = places
    return pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(grown.view(np.int64)), pa.array(rid.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in rest)], NAMES)


def _pieces(texts: Iterator[tuple[int, bytes]], length: int, core: int, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes of several short texts, or of a piece of a long one; in them the synchronizing positions,
    and rid, p, lo and hi of each, and whether its context is whole."""
    held: list[tuple] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        starts = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
        at = np.concatenate([x[2] + s for x, s in zip(held, starts)])
        return data, at, *(np.concatenate([x[i] for x in held]) for i in range(1, 6))

    for rid, text in texts:
        if len(text) < length:
            continue
        p, s1, s2 = (np.concatenate(x) for x in zip(*runs(text, length, core)))
        row = np.full(len(p), rid), p, p - s2, p - s1, (p >= reach) & (p + length <= len(text))
        if len(text) <= CHUNK:
            held.append((text, *row))
            size += len(text)
            if size >= CHUNK:
                yield joined()
                held, size = [], 0
            continue
        for at in range(0, len(text), CHUNK):
            here = np.flatnonzero((p >= at) & (p < at + CHUNK))
            base = max(0, at - reach)
            if len(here):
                yield np.frombuffer(text[base : at + CHUNK + length], np.uint8), p[here] - base, *(x[here] for x in row)
    if held:
        yield joined()


def _positions(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """All synchronizing positions with the ranks of their core and their context."""
    reach, core, context = block - 1, length - block + 1, length + block - 1
    k, wide = power(core), power(context)
    texts = ((rid, text.as_py()) for batch in batches for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.binary())) if text.is_valid)
    for data, at, rid, p, lo, hi, whole in _pieces(texts, length, core, reach):
        at_k = doubled(data, k)
        rank, grown = at_length(at_k, k, core, (at,)), edge(rid, p, np.zeros(len(p)))
        if whole.any():
            n = k
            while n < wide:
                at_k, n = pair(at_k[:-n], at_k[n:]), 2 * n
            grown[whole] = at_length(at_k, wide, context, (at[whole] - reach,))
        yield _ranked(rank, grown, rid, p, lo, hi)


def _contexts(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """The bytes around positions that grow on: up to block - 1 before, ``length`` from there."""
    for batch in batches:
        rows = []
        for rid, text, todo in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("todo").to_pylist()):
            text = text.as_py()
            for x in todo:
                start = max(0, x["p"] - block + 1)
                rows.append((rid, x["p"], x["lo"], x["hi"], x["p"] - start, text[start : x["p"] + length]))
                if len(rows) == 16 * ROWS:
                    yield _context_batch(rows)
                    rows = []
        yield _context_batch(rows)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:5]), pa.array(cols[5], pa.binary())], ["rid", "p", "lo", "hi", "before", "bytes"])


def _grown(batches: Iterator[pa.RecordBatch], length: int, reach: int, block: int) -> Iterator[pa.RecordBatch]:
    """Positions in blocks of so many windows, with the ranks of these blocks' cores and contexts; of
    single windows, with two ranks of each."""
    core, context = length - block + 1, length + block - 1
    k = power(core)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rid, p, lo, hi, before = (part.column(c).to_numpy().astype(np.int64) for c in ("rid", "p", "lo", "hi", "before"))
            texts = part.column("bytes").to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            # the position is in column ``reach`` of its row
            data = np.frombuffer(b"".join((b"\0" * (reach - b) + t).ljust(reach + length, b"\0") for b, t in zip(before.tolist(), texts)), np.uint8).reshape(len(texts), reach + length)
            count = hi // block - lo // block + 1
            row = np.repeat(np.arange(len(rid)), count)
            b = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo // block, count)
            at_k = doubled(data, k)
            from_core, from_context = reach - b * block, reach - b * block - block + 1
            salt = b.astype(np.uint64) * _ODD[1]
            rank = mixed(at_length(at_k, k, core, (row, from_core)) + salt)
            if block == 1:
                grown = at_length(doubled(data, k, 1), k, core, (row, from_core), 1)
            else:
                whole = (from_context >= reach - before[row]) & (from_context + context <= reach - before[row] + size[row])
                if context > 2 * k:
                    raise ValueError(f"a block of {block} of {length} is too large to grow by one doubling")
                grown = edge(rid[row], p[row], b)
                grown[whole] = mixed(at_length(at_k, k, context, (row[whole], from_context[whole])) + salt[whole])
            yield _ranked(rank, grown, rid[row], p[row], np.maximum(lo[row], b * block), np.minimum(hi[row], b * block + block - 1))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist()):
            text = text.as_py() or b""
            sha, at, removed, n = hashlib.sha256(), 0, 0, 0
            for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                if n == 0 or a > at:
                    sha.update(text[at:a])
                    n += 1
                    removed += b - a
                    at = b
                elif b > at:
                    removed += b - at
                    at = b
            sha.update(text[at:])
            rows.append((len(text), removed, n, sha.hexdigest()))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _settled(spark: SparkSession, rows: DataFrame, length: int, last: bool) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """From positions with ranks: the spans (rid, a, b) settled as repeated, the positions that must
    grow on, if these aren't the last, and the paths of the tables behind them."""
    rows, rows_at = written(rows, "ranked")
    place = F.struct("rid", "p", "lo", "hi")
    classes, classes_at = written(rows.groupBy("rank", "grown").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "classes")
    total = rows.count()
    repeated = classes.where("n > 1").select("rank", "grown", "n")
    spans = split_join(rows, repeated, ["rank", "grown"], "n", total).select("rid", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo") + length).alias("b"))
    spans, spans_at = written(spans, "spans")
    on, paths = None, [spans_at]
    if not last:
        # ranks with several positions, of which some are alone in their context
        ranks, ranks_at = written(classes.groupBy("rank").agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.count(F.lit(1)).alias("contexts")).where("total > 1 AND least = 1").select("rank", "contexts"), "ranks")
        on, on_at = written(split_join(classes.select("rank", "one"), ranks, ["rank"], "contexts", total).select("one.*"), "growing")
        dropped(spark, ranks_at)
        paths.append(on_at)
    dropped(spark, rows_at, classes_at)
    return spans, on, paths


def repeats(texts: DataFrame, length: int = LENGTH, blocks: tuple[int, ...] = BLOCKS) -> tuple[DataFrame, list[str]]:
    """Spans (rid, a, b) of bytes under strings of ``length`` bytes that start at two places or
    more, and the paths of the tables that hold them. ``texts`` has rid (unique) and text. Each of
    the ``blocks`` divides the one before; the last is 1."""
    spark = texts.sparkSession
    reach = blocks[0] - 1
    spans, on, paths = _settled(spark, texts.select("rid", "text").mapInArrow(lambda it: _positions(it, length, blocks[0]), ROW), length, len(blocks) == 1)
    lists = on.groupBy("rid").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("todo"))
    near, near_at = written(texts.join(lists, "rid").select("rid", "text", "todo").mapInArrow(lambda it: _contexts(it, length, blocks[0]), "rid long, p int, lo int, hi int, before int, bytes binary"), "contexts")
    todo = near
    for block in blocks[1:]:
        more, on, tables = _settled(spark, todo.mapInArrow(lambda it, block=block: _grown(it, length, reach, block), ROW), length, block == 1)
        spans, paths = spans.unionByName(more), [*paths, *tables]
        if on is not None:
            todo = on.join(near.select("rid", "p", "before", "bytes"), ["rid", "p"])
    return spans, [*paths, near_at]


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row a row of ``docs``.

    Texts are taken as UTF-8, a null text as empty. Removed is each byte under a string of
    ``length`` bytes that also starts elsewhere, in the same document or another, overlaps
    included, as judged on the input. n_spans counts maximal runs of removed bytes; adjoining
    spans are one run. Repeated rows are documents of their own, so copies of each other; a null
    doc_id stays null. Texts shorter than ``length`` are unchanged. Further columns are ignored.
    Empty table: no rows. Runs actions.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, _ = written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "texts")
    spans, paths = repeats(texts, length)
    lists, _ = written(spans.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "span-lists")
    dropped(spark, *paths)
    return texts.join(lists, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
