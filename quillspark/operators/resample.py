"""Resampling with draws that are a function of what is drawn: the same on any cluster.

The draw of an id is a digest of seed, analysis, question, repetition and id. A shuffle is the
order of these digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..schema import BOOTSTRAPS, MIN_IDS, SEED, SPLITS
from .agg import normalized_entropy
from .vectors import DIGEST, bare_digests, digests

#: Ids of a block, and draws that a task makes at once.
BLOCK, DRAWS = 4096, 65536


def repetitions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("rep"))


def draw(analysis: str, seed: int, *parts: str | Column) -> Column:
    return F.md5(head_of(analysis, seed, *parts))


def head_of(analysis: str, seed: int, *parts: str | Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(analysis), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def split_halves(ids: DataFrame, keys: Sequence[str] = ("question",), id_col: str = "respondent_id", n: int = SPLITS, analysis: str = "split", seed: int = SEED) -> DataFrame:
    """keys, rep, id and half (A or B): for each repetition the first half (rounded down) of the
    shuffled ids against the rest. ``ids`` are the baseline's distinct ids for each of keys."""
    # a fixed number of repetitions, so the broadcast side is bounded
    reps = ids.crossJoin(F.broadcast(repetitions(ids.sparkSession, n)))
    order = Window.partitionBy(*keys, "rep").orderBy(draw(analysis, seed, *keys, "rep", id_col), id_col)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "rep"))
    return reps.withColumn("half", F.when(F.row_number().over(order) <= F.floor(size / 2), "A").otherwise("B"))


def split_half_mean(df: DataFrame, keys: Sequence[str] = ("question",), id_col: str = "respondent_id", value: str = "value", n: int = SPLITS, analysis: str = "split", seed: int = SEED) -> DataFrame:
    """keys, rep and value: the noise floor of a mean difference, half A less half B, of the halves
    that ``split_halves`` gives.

    Digests are spread evenly, so the one that parts the halves lies close to the middle: ten
    standard deviations of its rank on either side. Ids below or above are summed where they are,
    for all repetitions at once, and only those between are ranked. So a task holds a batch of ids,
    and what is sorted grows as the root of the ids. If the parting digest ever were outside, an
    error would say so.
    """
    keys = list(keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id are summed first, so each id is drawn once
    per_id = df.groupBy(*keys, id_col).agg(F.sum(finite(F.col(value))).cast("double").alias("s"), F.count(finite(F.col(value))).cast("double").alias("c")).dropna(subset=keys)
    sizes = per_id.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # an id that is null has its place in a half, but no values
    known = F.col(id_col).isNotNull()
    placed = per_id.join(sizes, keys).select(*keys, "n", F.col(id_col).cast("string").alias("id"), F.when(known, F.col("s")).alias("s"), F.when(known, F.col("c")).otherwise(F.lit(0.0)).alias("c"), head_of(analysis, seed, *keys).alias("head"))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    sums = ("under", "sa", "ca", "sb", "cb")

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby([*keys, "n", "head"], sort=False):
                size, head = int(key[-2]), key[-1]
                low, high = _window(size)
                at = held.setdefault(key[:-1], np.zeros((len(sums), n)))
                ends = [b"" if i is None else b"|" + i.encode() for i in part["id"]]
                value, count = part["s"].fillna(0.0).to_numpy(np.float64), part["c"].to_numpy(np.float64)
                between = []
                for rep in range(n):
                    d = bare_digests(f"{head}|{rep}".encode(), ends)
                    under, over = d["high"] < low, d["high"] > high
                    at[:, rep] += under.sum(), value[under].sum(), count[under].sum(), value[over].sum(), count[over].sum()
                    rows = np.flatnonzero(~(under | over))
                    between.append((np.full(len(rows), rep, np.int32), rows, d[rows]))
                rows = np.concatenate([r for _, r, _ in between])
                # numpy joins records in the machine's order of bytes
                d = np.concatenate([x for _, _, x in between]).astype(DIGEST)
                yield pd.DataFrame({**dict(zip(keys, key)), "n": size, "rep": np.concatenate([r for r, _, _ in between]), "digest": [x.tobytes() for x in d], "id": part["id"].to_numpy()[rows], "under": 0.0, "s": value[rows], "c": count[rows], "sa": 0.0, "ca": 0.0, "sb": 0.0, "cb": 0.0})
        for key, at in held.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "n": int(key[-1]), "rep": np.arange(n, dtype=np.int32), "digest": None, "id": None, "s": 0.0, "c": 0.0, **dict(zip(sums, at))})

    keyed = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    # a number of tasks, as adaptive execution would join tasks that read little but work long
    found = placed.repartition(tasks, *keys, "id").mapInPandas(parted, keyed + ", n long, rep int, digest binary, id string, s double, c double, " + ", ".join(f"{x} double" for x in sums))
    group = Window.partitionBy(*keys, "rep")
    between = F.col("digest").isNotNull()
    rank = F.sum(between.cast("long")).over(group.orderBy(F.col("digest").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half, under = F.floor(F.col("n") / 2), F.sum("under").over(group)
    ranked = found.withColumn("_a", between & (under + rank <= half)).withColumn("_ok", (under <= half) & (under + F.sum(between.cast("long")).over(group) >= half))
    add = lambda x, h: F.sum(F.col(f"{x}{h}") + F.when(between & (F.col("_a") if h == "a" else ~F.col("_a")), F.col(x)).otherwise(F.lit(0.0)))
    out = ranked.groupBy(*keys, "rep").agg((F.try_divide(add("s", "a"), add("c", "a")) - F.try_divide(add("s", "b"), add("c", "b"))).alias("value"), F.min("_ok").alias("_ok"))
    return out.select(*keys, "rep", F.when(F.col("_ok"), F.col("value")).otherwise(F.raise_error(F.lit("the parting digest is outside of its window")).cast("double")).alias("value"))


def _window(size: int, deviations: float = 10.0) -> tuple[np.uint64, np.uint64]:
    """Between which first halves of a digest the one that parts ``size`` ids is."""
    share = (size // 2) / size
    reach = deviations * math.sqrt(share * (1 - share) / size) + 2 / size
    return np.uint64(max(0, int((share - reach) * 2**64))), np.uint64(min(2**64 - 1, int((share + reach) * 2**64)))


def bootstrap_entropy(df: DataFrame, keys: Sequence[str] = ("question", "dataset"), id_col: str = "respondent_id", value: str = "key", n: int = BOOTSTRAPS, seed: int = SEED, least: int = MIN_IDS, multiplicity: bool = False) -> DataFrame:
    """keys, rep, entropy: the normalised entropy of the answers of ids drawn with replacement.

    As many draws as ids. An id drawn several times counts once, unless ``multiplicity``. Groups
    of fewer than ``least`` ids have no rows.

    A task draws one repetition of a group at a time, and sends bits (with ``multiplicity``, numbers)
    for blocks of ids; where these meet the block's answers, all repetitions are counted at once, so
    no id is a row once for each repetition.
    """
    keys = list(keys)
    ids = df.select(*keys, id_col).distinct().dropna(subset=keys)
    w = Window.partitionBy(*keys)
    ids = ids.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("slot", F.row_number().over(w.orderBy(id_col)) - 1).where(F.col("n") >= least)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keyed = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of tasks, as adaptive execution would join tasks that read little but work long
    groups = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(repetitions(df.sparkSession, n))).withColumn("head", head_of("bootstrap", seed, *keys, "rep")).repartition(tasks, *keys, "rep")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                *parts, size, rep, head = row
                times = np.zeros(-(-size // BLOCK) * BLOCK, np.uint16)
                for at in range(0, size, DRAWS):
                    picks = digests(head, [b"%d" % i for i in range(at, min(size, at + DRAWS))])["high"] >> np.uint64(32)
                    np.add.at(times, (picks % np.uint64(size)).astype(np.int64), 1)
                blocks = times.reshape(-1, BLOCK)
                sent = [b.tobytes() if multiplicity else np.packbits(b > 0).tobytes() for b in blocks]
                yield pd.DataFrame({**{k: [p] * len(sent) for k, p in zip(keys, parts)}, "block": np.arange(len(sent)), "rep": np.int32(rep), "times": sent})

    picked = groups.mapInPandas(drawn, keyed + ", block long, rep int, times binary")
    answers = df.where(F.col(value).isNotNull()).groupBy(*keys, id_col, value).agg(F.count(F.lit(1)).alias("c"))
    placed = answers.join(ids.select(*keys, id_col, "slot"), [*keys, id_col])
    placed = placed.select(*keys, F.floor(F.col("slot") / BLOCK).alias("block"), (F.col("slot") % BLOCK).alias("at"), F.col(value).alias("key"), "c")

    def counted(key: tuple, found: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "key", "counts"]
        if found.empty or sides.empty:
            return pd.DataFrame(columns=columns)
        code, names = pd.factorize(found["key"])
        order = np.argsort(code, kind="stable")
        code, at, c = code[order], found["at"].to_numpy(np.int64)[order], found["c"].to_numpy(np.int64)[order]
        sides = sides.sort_values("rep")
        read = (lambda b: np.frombuffer(b, np.uint16)) if multiplicity else (lambda b: np.unpackbits(np.frombuffer(b, np.uint8)))
        times = np.ascontiguousarray(np.stack([read(b) for b in sides["times"]]).T)
        out = []
        for i in range(0, len(at), BLOCK):
            part = code[i : i + BLOCK]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums = np.add.reduceat(times[at[i : i + BLOCK]] * c[i : i + BLOCK, None], starts, axis=0)
            out += [[*key[:-1], names[part[s]], row] for s, row in zip(starts, sums)]
        return pd.DataFrame(out, columns=columns)

    # a row for each block and answer with the counts of all repetitions; what is exploded is as much as the entropy takes
    counts = placed.groupBy(*keys, "block").cogroup(picked.groupBy(*keys, "block")).applyInPandas(counted, keyed + f", key {kinds[value]}, counts array<long>")
    weighted = counts.select(*keys, "key", F.posexplode("counts").alias("rep", "w")).where("w > 0")
    return normalized_entropy(weighted, [*keys, "rep"], "key", weight="w").select(*keys, "rep", "entropy")
