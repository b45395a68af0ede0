"""Exact top-k inner-product search in three phases with a uniform threshold.

The components of a vector are dealt to ``nodes`` score lists, so a pair's score is the sum of
its local scores. Phase 1 gathers, for each query, the k best entries of every local list of
every partition; the k-th best whole score among them bounds the true k-th best from below and
is broadcast as a safe cutoff. Phase 2 collects the entries with a local score of at least
cutoff / nodes in some list: any other pair sums to less than the cutoff. A pair whose upper
bound (local scores seen, cutoff / nodes for those unseen) is below the cutoff is dropped.
Phase 3 resolves the scores of what is left exactly.

Queries are taken in blocks of bounded size; a block is all that is ever sent to the driver or
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import dropped, new_path, written

SCALE = 64
NODES = 4
BLOCK = 4096
ROWS = 1024


def usable(vector: Column) -> Column:
    """True for a vector that is neither null nor empty and whose components are all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def matrix(column: pa.ChunkedArray, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the row numbers and floor(scale * x) of the vectors of that length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64), column.offsets.to_numpy()[:-1]
    out = {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = rows, np.floor(scale * flat[starts[rows][:, None] + np.arange(n)])
    return out


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """The narrowest type in which every sum of products of integers is exact."""
    most = float(np.abs(q).sum(axis=1).max(initial=0) * np.abs(x).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def whole_numbers(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


def as_long(score: np.ndarray) -> np.ndarray:
    """Scores as longs; what is beyond these is the greatest or the least one."""
    if score.dtype == object:
        score = np.array([max(-(2**63), min(2**63 - 1, v)) for v in score], object)
    return score.astype(np.int64)


def local_scores(q: np.ndarray, x: np.ndarray, nodes: int) -> list[np.ndarray]:
    kind = exact_type(q, x)
    q, x = whole_numbers(q, kind), whole_numbers(x, kind)
    cuts = np.linspace(0, q.shape[1], min(nodes, q.shape[1]) + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts, cuts[1:])]


def tops(score: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest of each row, in any order."""
    return np.argpartition(score, score.shape[1] - k, axis=1)[:, -k:] if k < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)


def phase_one(batches: Iterator[pa.RecordBatch], queries: dict, scale: int, nodes: int, k: int) -> Iterator[pa.RecordBatch]:
    """A partition's best whole scores of each query among the entries of its local lists."""
    best = {n: np.full((len(idx), k), -np.inf) for n, (idx, _, _) in queries.items()}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for n, (rows, x) in matrix(batch.column("embedding"), scale).items():
            if n not in queries:
                continue
            _, own, q = queries[n]
            for at in range(0, len(rows), ROWS):
                part = local_scores(q, x[at : at + ROWS], nodes)
                whole = np.sum(part, axis=0).astype(np.float64)
                # entries of several lists count once; the query's own rows don't count
                listed = np.zeros(whole.shape, bool)
                for p in part:
                    np.put_along_axis(listed, tops(p.astype(np.float64) if p.dtype == object else p, k), True, axis=1)
                listed &= ids[rows[at : at + ROWS]][None, :] != own[:, None]
                whole[~listed] = -np.inf
                both = np.concatenate([best[n], np.take_along_axis(whole, tops(whole, k), axis=1)], axis=1)
                best[n] = -np.partition(-both, k - 1, axis=1)[:, :k]
    for n, (idx, _, _) in queries.items():
        q_at, _ = np.nonzero(np.isfinite(best[n]))
        yield pa.RecordBatch.from_arrays([pa.array(idx[q_at], pa.int64()), pa.array(best[n][np.isfinite(best[n])], pa.float64())], ["q", "score"])


def phase_two_three(batches: Iterator[pa.RecordBatch], queries: dict, cutoff: np.ndarray, scale: int, nodes: int, k: int) -> Iterator[pa.RecordBatch]:
    """A partition's k first entries of each query that reach its cutoff, ties to the smaller id."""
    held = {n: [np.empty((0, 3), np.int64)] for n in queries}

    def first(n: int) -> None:
        e = np.concatenate(held[n])
        e = e[np.lexsort((e[:, 1], -e[:, 2], e[:, 0]))]
        start = np.searchsorted(e[:, 0], e[:, 0])
        held[n] = [e[np.arange(len(e)) - start < k]]

    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for n, (rows, x) in matrix(batch.column("embedding"), scale).items():
            if n not in queries:
                continue
            idx, own, q = queries[n]
            order = np.argsort(ids[rows], kind="stable")
            rows, x = rows[order], x[order]
            least = cutoff[idx]
            for at in range(0, len(rows), ROWS):
                here = ids[rows[at : at + ROWS]]
                part = local_scores(q, x[at : at + ROWS], nodes)
                share = (least / len(part))[:, None]
                seen = np.zeros(part[0].shape, bool)
                upper = np.zeros(part[0].shape)
                for p in part:
                    near = p.astype(np.float64) if p.dtype == object else p
                    seen |= near >= share
                    upper += np.maximum(near, share)
                keep = seen & (upper >= least[:, None]) & (here[None, :] != own[:, None])
                q_at, x_at = np.nonzero(keep)
                score = np.sum([p[q_at, x_at] for p in part], axis=0) if len(q_at) else np.empty(0, np.int64)
                ok = score.astype(np.float64) >= least[q_at]
                q_at, x_at, score = q_at[ok], x_at[ok], as_long(score[ok])
                # rows are in order of id, so a stable sort by score leaves ties so
                order = np.lexsort((x_at, -score, q_at))
                q_at, x_at, score = q_at[order], x_at[order], score[order]
                top = np.arange(len(q_at)) - np.searchsorted(q_at, q_at) < k
                held[n].append(np.stack([idx[q_at[top]], here[x_at[top]], score[top]], axis=1))
                if sum(map(len, held[n])) > 4 * k * len(idx) + 100_000:
                    first(n)
    for n in queries:
        first(n)
        e = held[n][0]
        yield pa.RecordBatch.from_arrays([pa.array(e[:, j], pa.int64()) for j in range(3)], ["q", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, nodes: int = NODES, block: int = BLOCK) -> DataFrame:
    """For each query row its k highest scores: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; a component x counts as floor(scale * x). Candidates
    are all rows with another vec_id than the query's, ties go to the smaller vec_id. Rows with
    a null vec_id, and vectors that are null, empty or hold null or non-finite components, take
    no part; vectors of different lengths are not compared. Repeated candidate rows each count;
    a repeated query row is answered once for each row. A query without candidates has no rows.
    Scores are exact; beyond the range of a long they are its greatest or
    least value, and ties. Further columns are ignored. Runs actions.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    blocks = max(1, math.ceil(asked.count() / block))
    # a repeated id may put more rows into one block than planned, so rows are dealt by content too
    asked, asked_path = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks))), "topk-queries")
    out, ids = new_path(spark, "topk-entries"), new_path(spark, "topk-ids")
    offset = 0
    for b in range(blocks):
        got = asked.where(F.col("block") == b).select("vec_id", "embedding").toArrow()
        own = got.column("vec_id").to_numpy()
        queries = {n: (rows, own[rows], q) for n, (rows, q) in matrix(got.column("embedding"), scale).items()} if len(own) else {}
        lists = base.mapInArrow(lambda it, q=queries: phase_one(it, q, scale, nodes, k), "q long, score double")
        ranked = Window.partitionBy("q").orderBy(F.col("score").desc())
        lower = lists.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("q", "score").toArrow()
        cutoff = np.full(len(own), -np.inf)
        cutoff[lower.column("q").to_numpy()] = lower.column("score").to_numpy()
        entries = base.mapInArrow(lambda it, q=queries, c=cutoff: phase_two_three(it, q, c, scale, nodes, k), "q long, vec_id long, score long")
        entries.select((F.col("q") + offset).alias("q"), "vec_id", "score").write.mode("append").parquet(out)
        spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(own)) + offset, pa.int64()), "query_id": pa.array(own, pa.int64())})).write.mode("append").parquet(ids)
        offset += len(own)
    dropped(spark, asked_path)
    entries = spark.read.schema("q long, vec_id long, score long").parquet(out)
    ranked = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return (
        entries.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .join(spark.read.schema("q long, query_id long").parquet(ids), "q")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
