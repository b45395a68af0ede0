"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRU layers, one reading forwards and one backwards, give every byte a state of both sides; a
softmax over the states labels each position, and a document's probabilities are the mean of its
positions'. The network is trained here, in numpy, by backpropagation through time with Adam, on
a bounded sample of labelled rows; its minibatches are stretches drawn from anywhere in their texts.
Texts are lower-cased and read whole. To read many positions at once they are cut into segments of
``SEGMENT`` bytes; a segment's state on either side is carried over from the ``WARM`` bytes before or
after it, which the network reads for the state alone. Only a text's ends start from a zero state.

Arrays have one column a segment, so a step of all segments is a few matrix operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import unused

HIDDEN = 8
SEGMENT = 256
WARM = 32
COLUMNS = 1024
#: Bound of the training sample: documents in all, and so languages, too.
SAMPLE_DOCS = 1600
TRAIN_LENGTH = 48
TRAIN_BATCH = 256
TRAIN_STEPS = 220
RATE = 0.02


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def new_weights(classes: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """For either direction d: input tables Wd (3 hidden x 256), recurrent Ud (3 hidden x hidden),
    bias cd of the candidate, output Vd; and the output's bias b. Rows of W and U are those of
    update gate, reset gate and candidate."""
    w = {"b": np.zeros((classes, 1))}
    for d in "fb":
        w[f"W{d}"] = rng.normal(0, 0.5, (3 * hidden, 256))
        w[f"U{d}"] = rng.normal(0, 1 / math.sqrt(hidden), (3 * hidden, hidden))
        w[f"c{d}"] = np.zeros((hidden, 1))
        w[f"V{d}"] = rng.normal(0, 0.3, (classes, hidden))
    return {k: v.astype(np.float32) for k, v in w.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def loss_and_gradient(w: dict[str, np.ndarray], ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of ``ids`` (length x segments) whose segments have
    the classes ``labels``, and its gradient by backpropagation through time."""
    length, n = ids.shape
    hidden = w["cf"].shape[0]
    tape: dict[str, list] = {"f": [None] * length, "b": [None] * length}
    states = {}
    for d in "fb":
        h = np.zeros((hidden, n), w["b"].dtype)
        states[d] = np.empty((length, hidden, n), h.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, u = w[f"W{d}"][:, ids[t]], w[f"U{d}"] @ h
            z = sigmoid(a[:hidden] + u[:hidden])
            r = sigmoid(a[hidden : 2 * hidden] + u[hidden : 2 * hidden])
            g = u[2 * hidden :] + w[f"c{d}"]
            c = np.tanh(a[2 * hidden :] + r * g)
            tape[d][t] = (h, z, r, g, c)
            h = states[d][t] = c + z * (h - c)
    logits = w["Vf"] @ states["f"] + w["Vb"] @ states["b"] + w["b"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(p[:, labels, np.arange(n)] + 1e-12).mean()
    p[:, labels, np.arange(n)] -= 1
    p /= length * n
    grad = {"b": p.sum(axis=(0, 2))[:, None]}
    for d in "fb":
        U, V = w[f"U{d}"], w[f"V{d}"]
        grad[f"V{d}"] = np.einsum("tcn,thn->ch", p, states[d])
        dU, dc = np.zeros_like(U), np.zeros_like(w[f"c{d}"])
        da = np.empty((length, 3 * hidden, n), U.dtype)
        dh = np.zeros((hidden, n), U.dtype)
        for t in range(length - 1, -1, -1) if d == "f" else range(length):
            h, z, r, g, c = tape[d][t]
            dh = dh + V.T @ p[t]
            dan = dh * (1 - z) * (1 - c * c)
            dg = dan * r
            du = np.concatenate([dh * (h - c) * z * (1 - z), dan * g * r * (1 - r), dg])
            da[t] = du
            da[t, 2 * hidden :] = dan
            dU += du @ h.T
            dc += dg.sum(axis=1, keepdims=True)
            dh = dh * z + U.T @ du
        flat = ids.ravel()
        grad[f"W{d}"] = np.stack([np.bincount(flat, da[:, i].ravel(), 256) for i in range(3 * hidden)]).astype(U.dtype)
        grad[f"U{d}"], grad[f"c{d}"] = dU, dc
    return float(loss), grad


def train(texts: list[bytes], labels: list[int], classes: int, seed: int = 0, steps: int = TRAIN_STEPS, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Adam over random stretches of the texts; each class is drawn equally often."""
    rng = np.random.default_rng(seed)
    w = new_weights(classes, hidden, rng)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    by = [[i for i, c in enumerate(labels) if c == k] for k in range(classes)]
    data = [np.frombuffer(t, np.uint8) for t in texts]
    for step in range(1, steps + 1):
        ids = np.zeros((TRAIN_BATCH, TRAIN_LENGTH), np.int64)
        y = rng.integers(0, classes, TRAIN_BATCH)
        for j, k in enumerate(y):
            t = data[by[k][rng.integers(len(by[k]))]]
            at = rng.integers(0, max(1, len(t) - TRAIN_LENGTH + 1))
            piece = t[at : at + TRAIN_LENGTH]
            ids[j] = np.resize(piece, TRAIN_LENGTH)
        _, grad = loss_and_gradient(w, np.ascontiguousarray(ids.T), y)
        norm = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, step / 20) * (0.1 + 0.9 * (1 - step / steps))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return w


class Reader:
    """The trained network over many segments at once, in preallocated arrays."""

    def __init__(self, w: dict[str, np.ndarray], columns: int = COLUMNS, segment: int = SEGMENT):
        self.hidden, self.classes = w["cf"].shape[0], w["b"].shape[0]
        self.columns, self.segment = columns, segment
        h = self.hidden
        self.parts = {}
        for d in "fb":
            # gates as tanh of half the sum; the reset gate's 1/2 goes into the candidate's part
            scale = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)[:, None]
            half = np.full((3 * h, 1), 0.5, np.float32)
            self.parts[d] = np.ascontiguousarray(w[f"W{d}"] * scale), np.ascontiguousarray(w[f"U{d}"] * half), 0.5 * w[f"c{d}"], np.ascontiguousarray(w[f"V{d}"])
        self.b = w["b"]

    def _steps(self, d: str, ids: np.ndarray, order: range) -> Iterator[tuple[int, np.ndarray]]:
        W, U, c, _ = self.parts[d]
        h, n = self.hidden, ids.shape[1]
        state = np.zeros((h, n), np.float32)
        a, u, x = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32)
        for t in order:
            np.take(W, ids[t], axis=1, out=a, mode="clip")
            np.matmul(U, state, out=u)
            gates, cand, g = a[: 2 * h], a[2 * h :], u[2 * h :]
            gates += u[: 2 * h]
            np.tanh(gates, out=gates)
            g += c
            np.multiply(g, gates[h:], out=x)
            cand += g
            cand += x
            np.tanh(cand, out=cand)
            state -= cand
            z = gates[:h]
            z += 1
            z *= 0.5
            state *= z
            state += cand
            yield t, state

    def pooled(self, ids: np.ndarray, led: np.ndarray, core: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of positions WARM to ``core`` (classes x segments). ids is length
        x segments, filled up beyond ``ends``; before WARM it counts only where ``led`` says so."""
        first, last = 0 if led.any() else WARM, int(core.max())
        forward = np.empty((last - WARM, self.hidden, ids.shape[1]), np.float32)
        for t, state in self._steps("f", ids, range(first, last)):
            if t >= WARM:
                forward[t - WARM] = state
            elif t == WARM - 1 and not led.all():
                state *= led
        Vf, Vb = self.parts["f"][3], self.parts["b"][3]
        total = np.zeros((self.classes, ids.shape[1]), np.float32)
        short, least = int(ends.min()), int(core.min())
        for t, state in self._steps("b", ids, range(len(ids) - 1, WARM - 1, -1)):
            if t >= short:
                state *= (ends > t).astype(np.float32)
            if t >= last:
                continue
            p = Vf @ forward[t - WARM]
            p += Vb @ state
            p += self.b
            np.minimum(p, 60, out=p)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if t >= least:
                p *= core > t
            total += p
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Documents x classes: mean probability over all positions of each text; zeros where it
        is empty."""
        out = np.zeros((len(texts), self.classes))
        rows: list[tuple[int, bool, int, bytes]] = []
        S = self.segment

        def flush() -> None:
            # shorter segments together, so that few steps have columns that have ended
            rows.sort(key=lambda r: (-len(r[3]), r[1]))
            for at in range(0, len(rows), self.columns):
                part = rows[at : at + self.columns]
                led, core, ends = (np.array(x) for x in ([r[1] for r in part], [WARM + r[2] for r in part], [(0 if r[1] else WARM) + len(r[3]) for r in part]))
                width = int(ends.max())
                ids = np.frombuffer(b"".join((t if lead else b"\0" * WARM + t).ljust(width, b"\0") for _, lead, _, t in part), np.uint8).reshape(len(part), width)
                total = self.pooled(np.ascontiguousarray(ids.T).astype(np.intp), led, core, ends)
                np.add.at(out, [r[0] for r in part], total.T)
            rows.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), S):
                rows.append((i, at > 0, min(S, len(text) - at), text[max(0, at - WARM) : at + S + WARM]))
                if len(rows) == 4 * self.columns:
                    flush()
        flush()
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def _predict(batches: Iterator[pa.RecordBatch], w: dict[str, np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text and whether it has a letter; the others are kept."""
    reader = Reader(w) if names else None
    for batch in batches:
        letters = batch.column(batch.num_columns - 1).to_pylist()
        langs, scores = [], []
        held: list[bytes] = []

        def flush() -> None:
            p = reader.probabilities(held) if reader else np.zeros((len(held), 1))
            best = p.argmax(axis=1)
            for t, k, row in zip(held, best, p):
                langs.append(names[k] if t and reader else "und")
                scores.append(float(min(1.0, row[k])) if t and reader else 0.0)
            held.clear()

        size = 0
        for x, ok in zip(batch.column(batch.num_columns - 2), letters):
            held.append(x.as_py().lower().encode() if ok else b"")
            size += len(held[-1])
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        kept = batch.schema.names[:-2]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])


def fitted(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS, steps: int = TRAIN_STEPS) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights and language names learned from the text and lang of the rows ``usable`` holds for.

    The sample is bounded: ``sample_docs`` documents at most, spread evenly over the languages by a
    hash of the text. So it can't hold more languages than documents; the most frequent ones come
    first. Of each document as many stretches are drawn as training reads, from anywhere in it.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.where(usable & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(sample_docs).collect()
    if not counts:
        return {}, []
    each = max(1, sample_docs // len(counts))
    shares = F.map_from_entries(F.array(*[F.struct(F.lit(r["lang"]), F.lit(min(1.0, each / r["count"]))) for r in counts]))
    share = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0))
    hashed = F.xxhash64("text")
    order = F.pmod(hashed, F.lit(1 << 30))
    chosen = rows.where(has_letter & (order < share * (1 << 30))).select("lang", "text", hashed.alias("hashed"), order.alias("order"))
    # a hash that many copies share may take in more than its share, so the bound is set again
    draws = F.sequence(F.lit(0), F.lit(max(1, math.ceil(steps * TRAIN_BATCH / sample_docs)) - 1))
    room = F.greatest(F.length("text") - TRAIN_LENGTH + 1, F.lit(1)).cast("long")
    stretches = F.array_distinct(F.transform(draws, lambda j: F.substr("text", (F.pmod(F.xxhash64("hashed", j), room) + 1).cast("int"), F.lit(TRAIN_LENGTH))))
    found = chosen.select("order", "lang", stretches.alias("stretches")).dropDuplicates(["lang", "stretches"]).orderBy("order", "lang").limit(sample_docs).collect()
    names = sorted({r["lang"] for r in found})
    if not names:
        return {}, []
    index = {n: i for i, n in enumerate(names)}
    texts = [(s.lower().encode(), index[r["lang"]]) for r in found for s in r["stretches"]]
    return train([t for t, _ in texts], [k for _, k in texts], len(names), steps=steps), names


def predicted(docs: DataFrame, w: dict[str, np.ndarray], names: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score, one row a row.

    lang_pred is ``und`` with score 0 where the text is null or has no letter (or nothing was
    learned); else the language with the highest mean probability over all positions.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    text, has = unused("_text", list(keep)), unused("_letters", list(keep))
    return docs.select(*keep, F.col("text").alias(text), letters.alias(has)).mapInArrow(lambda it: _predict(it, w, names), f"{schema}, lang_pred string, score double")


def identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = TRAIN_STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a row of ``docs``.

    Learned from text and non-null lang of the rows that aren't held out (crc32 of doc_id as text,
    mod 3, is not 1); a null doc_id is the empty text there. Repeated rows stay; further columns
    are ignored; an empty table gives no rows. Runs actions.
    """
    w, names = fitted(docs, fold(F.col("doc_id")) != 1, sample_docs, steps)
    out = predicted(docs, w, names)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
