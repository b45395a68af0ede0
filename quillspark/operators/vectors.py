"""Energy distance between sets of unit vectors, and its permutation test.

The distance of two unit vectors is sqrt(max(0, 2 - 2 x.y)); the energy distance of X and Y is
twice the mean distance across less the mean distances within either (over pairs i < j), at
least 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASELINE, PERMUTATIONS, SEED

#: Vectors of a block; a task of the energy distance holds two.
BLOCK = 2048
#: Vectors of a block where sides are shuffled, rows of distances that are worked on at once, and
#: shuffles that a task draws.
SHUFFLED, STRIP, DRAWN = 4096, 512, 40
#: A digest as two numbers in its own order.
DIGEST = np.dtype([("high", ">u8"), ("low", ">u8")])


def pair_means(v: DataFrame, keys: Sequence[str], baseline: str = BASELINE, block: int = BLOCK) -> DataFrame:
    """keys, x, y, d: mean distances within each dataset (x = y, null below two vectors) and from the
    baseline (x) to the others, of a table (keys, dataset, i, e).

    Vectors are dealt by hash into blocks of about ``block``; a task takes a pair of blocks, by one
    matrix product, and gives a sum and a count. So a vector is sent as often as there are blocks to
    meet, no pair of vectors is ever a row, and a task holds two blocks however large a question is.
    """
    sizes = v.groupBy(*keys, "dataset").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # a row for each question and dataset: adaptive execution broadcasts it where it is small
    placed = v.join(sizes, [*keys, "dataset"]).select(*keys, "dataset", F.pmod(F.xxhash64("i", "e"), F.col("blocks").cast("long")).cast("int").alias("b"), "e")
    up_to = lambda first, n: F.explode(F.sequence(first, F.col(n) - 1))
    own = sizes.select(*keys, F.col("dataset").alias("x"), F.col("dataset").alias("y"), "blocks", up_to(F.lit(0), "blocks").alias("bx")).select(*keys, "x", "y", "bx", up_to(F.col("bx"), "blocks").alias("by"))
    base = sizes.where(F.col("dataset") == baseline).select(*keys, F.col("dataset").alias("x"), up_to(F.lit(0), "blocks").alias("bx"))
    others = sizes.where(F.col("dataset") != baseline).select(*keys, F.col("dataset").alias("y"), up_to(F.lit(0), "blocks").alias("by"))
    todo = own.unionByName(base.join(others, list(keys)))
    head = [*keys, "x", "y", "bx", "by"]
    left = placed.withColumnsRenamed({"dataset": "x", "b": "bx"}).join(todo, [*keys, "x", "bx"]).select(*head, F.lit(0).alias("side"), "e")
    right = placed.withColumnsRenamed({"dataset": "y", "b": "by"}).join(todo.where("NOT (x = y AND bx = by)"), [*keys, "y", "by"]).select(*head, F.lit(1).alias("side"), "e")
    rows = left.unionByName(right)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = ([np.asarray(e, np.float64) for e in pdf.loc[pdf["side"] == s, "e"]] for s in (0, 1))
        at = dict(zip(head, key))
        if (at["x"], at["bx"]) == (at["y"], at["by"]):
            s, n = distances(np.stack(a)).sum() / 2, len(a) * (len(a) - 1) // 2
        elif a and b:
            s, n = np.sqrt(np.clip(2.0 - 2.0 * (np.stack(a) @ np.stack(b).T), 0.0, None)).sum(), len(a) * len(b)
        else:  # a block that no vector was dealt to
            s, n = 0.0, 0
        return pd.DataFrame([[*key, s, n]], columns=[*head, "s", "n"])

    parts = rows.groupBy(*head).applyInPandas(sums, ", ".join(f"{c} {kinds[c]}" for c in head) + ", s double, n long")
    return parts.groupBy(*keys, "x", "y").agg(F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("d"))


def energy_distance(df: DataFrame, keys: Sequence[str] = ("question",), side: str = "dataset", id_col: str = "id", vector: str = "embedding", baseline: str = BASELINE, block: int = BLOCK) -> DataFrame:
    """keys, dataset, value: all pairs of each comparison, in blocks.

    The baseline's own mean is computed once for all systems. Null below two vectors a side. Null
    vectors, keys and datasets take no part; repeated rows each count.
    """
    v = df.select(*keys, F.col(side).alias("dataset"), F.col(id_col).alias("i"), F.col(vector).alias("e")).where(F.col("e").isNotNull())
    means = pair_means(v, keys, baseline, block)
    cross = means.where((F.col("x") == baseline) & (F.col("y") != baseline)).select(*keys, F.col("y").alias("dataset"), F.col("d").alias("xy"))
    own = means.where(F.col("x") == F.col("y")).select(*keys, F.col("x").alias("dataset"), F.col("d").alias("within"))
    base = own.where(F.col("dataset") == baseline).select(*keys, F.col("within").alias("base"))
    out = cross.join(own, [*keys, "dataset"], "left").join(base, list(keys), "left")
    return out.select(*keys, "dataset", F.greatest(F.lit(2.0) * F.col("xy") - F.col("base") - F.col("within"), F.lit(0.0)).alias("v"), F.col("base").isNull().alias("n1"), F.col("within").isNull().alias("n2")).select(*keys, "dataset", F.when(~F.col("n1") & ~F.col("n2"), F.col("v")).alias("value"))


def distances(z: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(2.0 - 2.0 * (z @ z.T), 0.0, None))
    np.fill_diagonal(d, 0.0)
    return d


def statistics(d: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The statistic of each column of a 0/1 matrix that says which rows are side X, by one
    matrix product: s_xx = diag(S'DS), and the other sums follow from it."""
    n = sides.sum(axis=0)
    m = len(d) - n
    ds = d @ sides
    xx = (sides * ds).sum(axis=0)
    xy = ds.sum(axis=0) - xx
    yy = d.sum() - xx - 2 * xy
    return np.maximum(0.0, 2 * xy / (n * m) - xx / (n * (n - 1)) - yy / (m * (m - 1)))


def shuffles(rows: Sequence[str], n: int, reps: int, seed: int, analysis: str, parts: Sequence[object] = (), first: int = 0) -> np.ndarray:
    """A 0/1 column for each repetition from ``first`` on: the n rows that come first by the digest of
    seed, analysis, parts, repetition and row, as ``resample.draw`` has it; equal rows in their order
    here."""
    out = np.zeros((len(rows), reps), np.uint8)
    ends = [row.encode() for row in rows]
    for r in range(reps if n else 0):
        at = digests("|".join(str(p) for p in (seed, analysis, *parts, first + r) if p is not None), ends)
        high = at["high"]
        last = np.partition(high, n - 1)[n - 1]
        out[high < last, r] = 1
        # rows that agree with the last one in half of their digest
        tied = np.flatnonzero(high == last)
        tied = tied[np.argsort(at["low"][tied], kind="stable")]
        out[tied[: n - int(out[:, r].sum())], r] = 1
    return out


def digests(head: str, ends: Sequence[bytes]) -> np.ndarray:
    """The MD5 digests of head, a bar and each end, as two big-endian numbers."""
    return bare_digests(f"{head}|".encode(), ends)


def bare_digests(start: bytes, ends: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.md5(start + end).digest() for end in ends]), DIGEST)


def _pair_sums(z: Sequence[np.ndarray], sides: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the pairs of vectors within one block or across two: for each column of 0/1 the sum of
    distances whose ends are both side X, and that of the distances of side X to all; and the sum of
    all distances. Each pair counts once. Strips of rows, so no whole block of distances is held."""
    other, across = sides[-1].astype(np.float64), len(z) > 1
    xx, xs, total = np.zeros(other.shape[1]), np.zeros(other.shape[1]), 0.0
    columns = np.zeros(len(z[-1]))
    for at in range(0, len(z[0]), STRIP):
        d = z[0][at : at + STRIP] @ z[-1].T
        d *= -2.0
        d += 2.0
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        if not across:
            rows = np.arange(len(d))
            d[rows, at + rows] = 0.0
        mine = sides[0][at : at + STRIP].astype(np.float64)
        xx += np.einsum("ij,ij->j", mine, d @ other)
        sums = d.sum(axis=1)
        xs += sums @ mine
        total += sums.sum()
        columns += d.sum(axis=0)
    return (xx, xs + columns @ other, total) if across else (xx / 2, xs, total / 2)


def resampled_energy(units: DataFrame, head: Sequence[str], n: int, seed: int, analysis: str, halves: bool = False, most: int | None = None, block: int = SHUFFLED) -> DataFrame:
    """head, n1, n2 and ``values``: the energy distances of two sides of each set of a table (head,
    base, i, e), first of base rows and others, then of each of n shuffles.

    A shuffle's first rows are side X, as many as there are base rows, or half of them with
    ``halves``; a row is drawn by base and i, or by i with ``halves``. Sets are dealt by hash into
    blocks of about ``block`` vectors. A task takes a pair of blocks and gives its share of three
    sums for every shuffle, so a task holds the vectors of two blocks, however large a set is; only
    the labels of a set, not its vectors, are held whole to draw some of the shuffles. The work is
    still quadratic. Sets of more than ``most`` vectors, if that is given, raise an error.
    """
    spark = units.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = list(head)
    kinds = {f.name: f.dataType.simpleString() for f in units.schema}
    keyed = ", ".join(f"`{c}` {kinds[c]}" for c in head)
    sizes = units.groupBy(*head).agg(F.count(F.lit(1)).alias("n"), F.sum("base").alias("n1"))
    same = units.join(sizes.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(head)], "n", "n1"), [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(head)])
    same = same.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = same.withColumn("b", F.pmod(F.xxhash64("base", "i"), F.col("blocks").cast("long")).cast("int"))
    packed = dealt.groupBy(*head, "n", "n1", "blocks", "b").agg(F.sort_array(F.collect_list(F.struct((-F.col("base")).alias("o"), "i", "e"))).alias("rows"))
    label = (lambda r: r["i"]) if halves else (lambda r: F.concat_ws("|", (-r["o"]).cast("string"), r["i"]))
    labels = packed.select(*head, "n", "n1", "b", F.transform("rows", label).alias("labels")).groupBy(*head, "n", "n1").agg(F.sort_array(F.collect_list(F.struct("b", "labels"))).alias("of"))
    # a fixed number of repetitions, so the broadcast side is bounded
    parts = F.broadcast(spark.range(0, n, DRAWN).select(F.col("id").cast("int").alias("first")))
    # a number of tasks, as adaptive execution would join tasks that read little but work long
    drawing = labels.crossJoin(parts).repartition(tasks, *head, "first").groupBy(*head, "first")

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, out, at = pdf.iloc[0], [], 0
        if most is not None and row["n"] > most:
            raise ValueError(f"{row['n']} vectors in one comparison; at most {most}")
        lists = [list(x["labels"]) for x in row["of"]]
        *parts, first = key
        found = shuffles(sum(lists, []), int(row["n"] // 2 if halves else row["n1"]), min(DRAWN, n - first), seed, analysis, [None if p is None or p != p else p for p in parts], first)
        for x, of in zip(row["of"], lists):
            out.append([*key, x["b"], np.packbits(found[at : at + len(of)], axis=1).tobytes()])
            at += len(of)
        return pd.DataFrame(out, columns=[*head, "first", "b", "bits"])

    drawn = drawing.applyInPandas(draw, keyed + ", first int, b int, bits binary").groupBy(*head, "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "bits"))), lambda x: x["bits"]).alias("bits"))
    drawn = drawn.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(head)], F.col("b").alias("_b"), "bits")
    blocks = packed.join(drawn, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(head)] + [F.col("b") == F.col("_b")])
    # plain arrays, which reach Python as such; rows of structs would take many times their size there
    flat = (F.transform("rows", lambda r: -r["o"]).alias("base"), F.flatten(F.transform("rows", lambda r: r["e"])).alias("e"))
    paired = blocks.select(*head, "n", "n1", "b", *flat, "bits", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")).withColumn("x", F.least("b", "to")).withColumn("y", F.greatest("b", "to"))

    def share(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, z, sides = pdf.sort_values("b"), [], []
        for base, e, bits in zip(pdf["base"], pdf["e"], pdf["bits"]):
            z.append(np.asarray(e, np.float64).reshape(len(base), -1))
            found = [np.asarray(base, np.uint8)[:, None]]
            for at, b in zip(range(0, n, DRAWN), bits):
                found.append(np.unpackbits(np.frombuffer(b, np.uint8).reshape(len(base), -1), axis=1, count=min(DRAWN, n - at)))
            sides.append(np.concatenate(found, axis=1))
        if len(z) == 1 and key[-2] != key[-1]:  # a block that no vector was dealt to
            xx, xs, total = np.zeros(n + 1), np.zeros(n + 1), 0.0
        else:
            xx, xs, total = _pair_sums(z, sides)
        return pd.DataFrame([[*key[:-2], pdf["n"].iloc[0], pdf["n1"].iloc[0], key[-2], key[-1], xx, xs, total]], columns=[*head, "n", "n1", "x", "y", "xx", "xs", "total"])

    shares = paired.repartition(tasks, *head, "x", "y").groupBy(*head, "x", "y").applyInPandas(share, keyed + ", n long, n1 long, x int, y int, xx array<double>, xs array<double>, total double")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        xx, xs, total = pdf["xx"].sum(), pdf["xs"].sum(), pdf["total"].sum()
        size = int(pdf["n"].iloc[0])
        x = np.full(n + 1, size // 2 if halves else pdf["n1"].iloc[0], np.float64)
        x[0] = pdf["n1"].iloc[0]
        y = size - x
        with np.errstate(divide="ignore", invalid="ignore"):
            values = np.maximum(0.0, 2 * (xs - 2 * xx) / (x * y) - 2 * xx / (x * (x - 1)) - 2 * (total - xs + xx) / (y * (y - 1)))
        return pd.DataFrame([[*key, int(x[0]), size - int(x[0]), values]], columns=[*head, "n1", "n2", "values"])

    return shares.groupBy(*head).applyInPandas(whole, keyed + ", n1 long, n2 long, values array<double>")


def permutation_test(df: DataFrame, keys: Sequence[str] = ("question",), side: str = "dataset", id_col: str = "id", vector: str = "embedding", n: int = PERMUTATIONS, seed: int = SEED, baseline: str = BASELINE, most: int | None = None) -> DataFrame:
    """keys, dataset, value and p = (1 + permutations that reach the value) / (n + 1).

    All keys and systems at once, in pairs of blocks: see ``resampled_energy``. A comparison of more
    than ``most`` vectors, if that is given, raises an error; nothing is sampled. Null below two
    vectors a side. A row is drawn by 1 (baseline) or 0 and its id, under the comparison's keys and
    dataset. Null vectors take no part.
    """
    v = df.select(*keys, F.col(side).alias("dataset"), F.col(id_col).cast("string").alias("i"), F.col(vector).alias("e")).where(F.col("e").isNotNull())
    systems = v.where(F.col("dataset") != baseline).select(*keys, "dataset").distinct()
    base = v.where(F.col("dataset") == baseline).drop("dataset").join(systems, list(keys)).withColumn("base", F.lit(1))
    units = base.unionByName(v.where(F.col("dataset") != baseline).withColumn("base", F.lit(0)).select(base.columns))
    head = [*keys, "dataset"]
    found = resampled_energy(units, head, n, seed, "permutation", most=most)
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    value = F.col("values")[0]
    reach = F.size(F.filter(F.slice("values", 2, n), lambda x: x >= value - F.lit(1e-12)))
    return found.select(*head, F.when(enough, value).alias("value"), F.when(enough, (reach + F.lit(1)) / F.lit(n + 1.0)).alias("p"))


def split_half_energy(df: DataFrame, keys: Sequence[str] = ("question",), id_col: str = "id", vector: str = "embedding", n: int = 400, seed: int = SEED, most: int | None = None) -> DataFrame:
    """keys, rep, value: energy distance of random halves of one dataset, in the same way. Sets of
    fewer than 4 vectors have no rows."""
    units = df.select(*keys, F.lit(1).alias("base"), F.col(id_col).cast("string").alias("i"), F.col(vector).alias("e")).where(F.col("e").isNotNull())
    found = resampled_energy(units, keys, n, seed, "split", halves=True, most=most).where(F.col("n1") + F.col("n2") >= 4)
    return found.select(*keys, F.posexplode(F.slice("values", 2, n)).alias("rep", "value"))


def embed(texts: DataFrame, embedder, text: str = "text", batch: int = 64) -> DataFrame:
    """Adds ``embedding`` (unit vectors, array<float>) by ``embedder.encode(list of texts)``; the
    embedder is made once a task by ``embedder()`` if it is a class or function."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder() if callable(embedder) else embedder
        for pdf in batches:
            vectors = []
            values = pdf[text].fillna("").tolist()
            for at in range(0, len(values), batch):
                e = np.asarray(model.encode(values[at : at + batch]), np.float32)
                vectors += list(e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12))
            yield pdf.assign(embedding=vectors)

    return texts.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", embedding array<float>")
