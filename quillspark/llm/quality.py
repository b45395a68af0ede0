"""Text quality by positive-unlabelled learning.

Trusted positives (labels of quality 1) and unlabelled web text train a small network by
minimising the non-negative unbiased risk

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

(Kiryo et al., 2017), with the logistic loss. Negative labels are never looked at. The class prior
is estimated first: a classifier of positives against unlabelled orders the texts, and the prior
is the least ratio of unlabelled to positive texts above a threshold (Garg et al., 2021), as above
a good threshold there are positives only. The network reads the whole text as hashed frequencies of
its pairs of bytes and of its words, of which training learns what counts, and some statistics.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import word_hashes
from .langid import fold

#: Bound of the training sample: so many positives and so many unlabelled texts, 2 * SAMPLE in all.
SAMPLE = 8000
#: Places that pairs of bytes, and words, are hashed to.
HASHED = 128
HIDDEN = 12
STEPS = 1500
#: Weight decay, and what hashed features are multiplied by so that the statistics count at first.
DECAY = 0.01
DAMPED = 0.1
BATCH = 512
NAMES = ("bytes", "words", "word_bytes", "upper", "lower", "digit", "mark", "other", "line", "pipe", "exclaim", "odd_mark", "distinct", "again", "line_distinct", "capital_words", "word_spread")

WIDTH = len(NAMES) + 2 * HASHED

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _c in (32, *range(9, 14)):
    _CLASS[_c] = 5
_ODD = [ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]


def hashed(values: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the values that fall to each of HASHED places."""
    at = (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)
    return np.sqrt(np.bincount(at, minlength=HASHED) / max(1, len(values)))


def features(text: str | None) -> np.ndarray:
    """Statistics of the whole text and hashed frequencies; a null text is empty, and all its
    features are 0 but for the ratios of distinct words and lines, which are 1."""
    data, w = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64), (text or "").split()
    return np.concatenate([statistics(text), hashed(data[:-1] << np.uint64(8) | data[1:]), hashed(word_hashes(w) if w else data[:0])])


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    n = max(1, len(data))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(_CLASS, hist, 6) / n
    w = (text or "").split()
    m = max(1, len(w))
    sizes = np.fromiter(map(len, w), np.float64, len(w)) if w else np.zeros(1)
    lines = [x for x in (text or "").split("\n") if x]
    return [
        np.log1p(len(data)), np.log1p(len(w)), (len(data) - hist[32]) / m, by[1], by[2], by[3], by[0], by[4], np.log1p(hist[10]) / np.log1p(m), hist[124] / m, hist[33] / m, hist[_ODD].sum() / m,
        (len(set(w)) / m) ** 0.5 if w else 1.0, sum(map(operator.eq, w, w[1:])) / m, len(set(lines)) / len(lines) if lines else 1.0, sum(map(str.isupper, w)) / m, float(sizes.std()) if w else 0.0,
    ]


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w["A"] + w["a"])
    return h, h @ w["v"] + w["b"]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pu_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of the outputs on positive and unlabelled texts, and the gradient to
    step along: where the negatives' part falls below zero, the one that raises it again."""
    positive = prior * _softplus(-fp).mean()
    negative = _softplus(fu).mean() - prior * _softplus(fp).mean()
    gu, gp = _sigmoid(fu) / len(fu), -prior * _sigmoid(fp) / len(fp)
    if negative < 0:
        return positive, -gp, -gu
    return positive + negative, gp - prior * _sigmoid(-fp) / len(fp), gu


def _minimised(xp: np.ndarray, xu: np.ndarray, risk, steps: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"A": rng.normal(0, xp.shape[1] ** -0.5, (xp.shape[1], HIDDEN)), "a": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        p, u = xp[rng.integers(0, len(xp), BATCH)], xu[rng.integers(0, len(xu), BATCH)]
        hp, fp = _forward(w, p)
        hu, fu = _forward(w, u)
        _, gp, gu = risk(fp, fu)
        grad = {"v": hp.T @ gp + hu.T @ gu, "b": np.array([gp.sum() + gu.sum()])}
        dp, du = np.outer(gp, w["v"]) * (1 - hp * hp), np.outer(gu, w["v"]) * (1 - hu * hu)
        grad["A"], grad["a"] = p.T @ dp + u.T @ du, dp.sum(axis=0) + du.sum(axis=0)
        rate = 0.01 * (1 - 0.95 * step / steps)
        for k, g in grad.items():
            g = g + DECAY * w[k] * (k != "b")
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(fp: np.ndarray, fu: np.ndarray) -> float:
    """The least ratio, over thresholds, of the shares of unlabelled and of positive texts above
    it, each with the slack its sample size allows."""
    t = np.unique(np.quantile(fp, np.linspace(0.02, 0.98, 97)))
    above_p, above_u = (np.array([(f >= x).mean() for x in t]) for f in (fp, fu))
    slack = np.sqrt(1 / len(fp)) + np.sqrt(1 / len(fu))
    at = ((above_u + slack) / above_p).argmin()
    # neither all nor none of the unlabelled, to what so many of them can tell
    return float(np.clip(above_u[at] / above_p[at], 1 / (len(fu) + 1), 1 - 1 / (len(fu) + 1)))


def train(xp: np.ndarray, xu: np.ndarray, steps: int = STEPS, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights, with the scaling of the statistics and the estimated prior."""
    both = np.concatenate([xp, xu])
    shift, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    xp, xu = (scaled(x, shift, scale) for x in (xp, xu))

    def against(fp: np.ndarray, fu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return 0.0, -_sigmoid(-fp) / len(fp), _sigmoid(fu) / len(fu)

    # the prior is estimated on the half that the ordering classifier has not seen, if there are two
    (p0, p1), (u0, u1) = ((x[0::2], x[1::2] if len(x) > 1 else x) for x in (xp, xu))
    w = _minimised(p0, u0, against, steps // 3, seed)
    prior = estimated_prior(_forward(w, p1)[1], _forward(w, u1)[1])
    w = _minimised(xp, xu, lambda fp, fu: pu_risk(fp, fu, prior), steps, seed + 1)
    return w | {"shift": shift, "scale": scale, "prior": np.array([prior])}


def scaled(x: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.clip((x - shift) / scale, -6, 6)
    out[:, len(NAMES) :] *= DAMPED
    return out


def score(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return _sigmoid(_forward(w, scaled(x, w["shift"], w["scale"]))[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t.as_py()) for t in batch.column("text")], np.float32).reshape(batch.num_rows, WIDTH)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), lists], ["positive", "unlabelled", "x"])


def _scores(batches: Iterator[pa.RecordBatch], w: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        out = np.full(n, 0.5)
        if w is not None and n:
            out = np.concatenate([score(w, np.array([features(t.as_py()) for t in batch.column("text").slice(at, 1000)], np.float32)) for at in range(0, n, 1000)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """Weights learned from the documents whose label is of quality 1 and from unlabelled ones,
    among those ``usable`` (of doc_id) holds for; None without both.

    The sample is bounded: about ``sample`` documents of either kind, taken by a hash of doc_id, and
    2 * ``sample`` rows in all, however often a doc_id is repeated.
    """
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    share = lambda n: F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)))
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & usable).select("doc_id").distinct()
    n_good, n_all = good.count(), docs.where(F.col("doc_id").isNotNull() & usable).count()
    if not n_good or not n_all:
        return None
    # bounded by the share, so it can be sent to all executors
    chosen = good.where(order < share(n_good)).withColumn("positive", F.lit(True))
    rows = docs.where(usable).select("doc_id", "text", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("web")), F.lit(1 << 30)) < share(n_all)).alias("unlabelled"))
    rows = rows.join(F.broadcast(chosen), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).where(F.col("positive") | F.col("unlabelled"))
    found = rows.select("text", "positive", "unlabelled").mapInArrow(_features, "positive boolean, unlabelled boolean, x array<float>")
    found = found.orderBy(F.xxhash64("x"), "positive", "unlabelled").limit(2 * sample).toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
    mix = np.random.default_rng(1).permutation(len(x))
    x, p, u = x[mix], found.column("positive").to_numpy()[mix], found.column("unlabelled").to_numpy()[mix]
    if not p.any() or not u.any():
        return None
    return train(x[p], x[u], steps)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a row of ``docs``.

    score (0 to 1) is higher where a label of quality 1 is likelier; predicted is 1 from 0.5 on.
    Learned from rows that aren't held out (crc32 of doc_id as text, mod 3, is not 1); labels,
    lang, source and doc_id are no inputs. Null texts are empty texts; empty texts get a score;
    rows with a null doc_id are scored but not learned from. Without positives or documents to
    learn from every score is 0.5. Repeated rows stay; further columns are ignored; an empty table
    gives no rows. Runs actions.
    """
    w = fitted(docs, labels, fold(F.col("doc_id")) != 1, sample, steps)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    out = rows.mapInArrow(lambda it: _scores(it, w), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
