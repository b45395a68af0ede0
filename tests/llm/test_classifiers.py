import random
import zlib

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from pyspark.sql import functions as F  # noqa: E402
from quillspark.llm import langid, quality  # noqa: E402

SYLLABLES = {"aa": "the and ing ion ent", "bb": "der die ung sch ich", "cc": "que les ment eau oui"}


def prose(rnd, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid.new_weights(3, 4, rng).items()}
    ids, y = rng.integers(0, 256, (5, 6)), rng.integers(0, 3, 6)
    _, grad = langid.loss_and_gradient(w, ids, y)
    for k, v in w.items():
        for _ in range(6):
            i = (rng.integers(v.shape[0]), int(rng.choice(ids.ravel())) if k[0] == "W" else rng.integers(v.shape[1]))
            keep = v[i]
            losses = []
            for e in (1e-5, -1e-5):
                v[i] = keep + e
                losses.append(langid.loss_and_gradient(w, ids, y)[0])
            v[i] = keep
            assert grad[k][i] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-6)


def plain(w, text, first=None, last=None, lo=0, hi=None):
    """Probabilities of each position from first to last, step by step; states are zero at lo and hi."""
    ids, n = np.frombuffer(text, np.uint8).astype(int), w["cf"].shape[0]
    hi = len(ids) if hi is None else hi
    states = {}
    for d in "fb":
        h, states[d] = np.zeros((n, 1)), {}
        for i in range(lo, hi) if d == "f" else range(hi - 1, lo - 1, -1):
            a, u = w[f"W{d}"][:, [ids[i]]], w[f"U{d}"] @ h
            z, r = langid.sigmoid(a[:n] + u[:n]), langid.sigmoid(a[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * (u[2 * n :] + w[f"c{d}"]))
            h = states[d][i] = c + z * (h - c)
    out = []
    for i in range(lo if first is None else first, hi if last is None else last):
        x = w["Vf"] @ states["f"][i] + w["Vb"] @ states["b"][i] + w["b"]
        q = np.exp(x - x.max())
        out.append((q / q.sum())[:, 0])
    return np.array(out).reshape(-1, w["b"].shape[0])


def test_reader_is_the_network_of_training():
    rng = np.random.default_rng(1)
    w = langid.new_weights(3, 8, rng)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, 30, 31, 32, 33, 95, 200, 0)]
    got = langid.Reader(w, columns=3, segment=32).probabilities(texts)
    for t, p in zip(texts, got):
        parts = [plain(w, t, at, min(len(t), at + 32), max(0, at - langid.WARM), min(len(t), at + 32 + langid.WARM)) for at in range(0, len(t), 32)]
        want = np.concatenate(parts).mean(axis=0) if t else np.zeros(3)
        assert np.allclose(p, want, atol=1e-4)
        # what lies farther than WARM bytes away hardly counts
        assert not t or np.allclose(p, plain(w, t).mean(axis=0), atol=2e-3)
    ids = np.frombuffer(texts[3], np.uint8)[:, None].astype(np.int64)
    for k in range(3):
        assert -langid.loss_and_gradient(w, ids, np.array([k]))[0] == pytest.approx(np.log(plain(w, texts[3])[:, k]).mean(), abs=1e-4)


def test_language_query_against_the_plain_network(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, lang, rnd.choice([5, 60, 300])), lang, 1, 2) for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text int, _letters int")
    w, names = langid.fitted(docs, langid.fold(F.col("doc_id")) != 1, steps=60)
    got = {r.doc_id: r for r in langid.identified(docs, steps=60).collect()}
    for i, text, *_ in rows:
        p = plain(w, text.lower().encode()).mean(axis=0)
        assert got[i].lang_pred == names[p.argmax()] and got[i].score == pytest.approx(p.max(), abs=2e-3)
    kept = langid.predicted(docs, w, names, keep=tuple(docs.columns))
    assert kept.columns == [*docs.columns, "lang_pred", "score"] and {(r._text, r._letters) for r in kept.collect()} == {(1, 2)}


def test_languages_of_held_out_texts(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, lang, rnd.choice([8, 40, 200])), lang, "x") for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(240))]
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 !? 34", "bb", "x"), (None, prose(rnd, "aa", 30), "aa", "x"), (1003, prose(rnd, "bb", 30), None, "x"), (5, rows[5][1], rows[5][2], "x"), (1004, prose(rnd, "cc", 20000), "cc", "x")]
    got = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string"), steps=150).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "aa" and by[1003].lang_pred == "bb" and by[1004].lang_pred == "cc" and by[None].held_out is False
    assert all(r.held_out == held_out(r.doc_id) for r in got if r.doc_id is not None)
    out = [(by[r[0]].lang_pred, r[2]) for r in rows[:240] if held_out(r[0])]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_without_anything_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identified(spark.createDataFrame([], schema)).count() == 0
    got = langid.identified(spark.createDataFrame([(1, "text", None)], schema)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_risk_gradient():
    rng = np.random.default_rng(0)
    for shift in (0.0, 4.0):  # the second makes the negatives' part fall below zero
        fp, fu = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 9)
        value, gp, gu = quality.pu_risk(fp, fu, 0.8)
        positive = 0.8 * np.logaddexp(0, -fp).mean()
        negative = np.logaddexp(0, fu).mean() - 0.8 * np.logaddexp(0, fp).mean()
        assert value == pytest.approx(positive + max(0.0, negative))
        sign = 1 if negative >= 0 else -1
        target = lambda p, u: (0.8 * np.logaddexp(0, -p).mean() if sign == 1 else 0) + sign * (np.logaddexp(0, u).mean() - 0.8 * np.logaddexp(0, p).mean())
        for f, g, pos in ((fp, gp, True), (fu, gu, False)):
            e = np.zeros_like(f)
            e[2] = 1e-6
            up, down = (target(fp + s * e, fu) if pos else target(fp, fu + s * e) for s in (1, -1))
            assert g[2] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8)


def test_prior_is_found():
    rng = np.random.default_rng(5)
    for prior in (0.3, 0.7):
        p, n = rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000)
        u = np.concatenate([p[4000 : 4000 + int(4000 * prior)], n[: int(4000 * (1 - prior))]])
        assert quality.estimated_prior(p[:4000], u) == pytest.approx(prior, abs=0.06)


def test_quality_of_held_out_texts(spark):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(1200):
        good = rnd.random() < 0.7
        t = prose(rnd, rnd.choice(list(SYLLABLES)), rnd.choice([30, 120]))
        if not good:
            t = rnd.choice([t.upper().replace(" ", "!! "), " ".join([t.split()[0]] * 80), t.replace(" ", " | "), t.replace(" ", "$%& ")])
        docs.append((i, t, 0.1))
        if rnd.random() < 0.5:
            labels.append((i, int(good), 0))
    truth = {i: q for i, q, _ in labels}
    docs += [(5000, None, 0.1), (5001, "", 0.1), (None, "some words", 0.1), (7, docs[7][1], 0.1)]
    labels += [(None, 1, 0), (9999, 1, 0), (3, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    got = quality.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert len(out) > 100 and sum(a == b for a, b in out) >= 0.95 * len(out)
    none = quality.scored(d, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5} and quality.scored(d.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality_query_against_plain_features(spark):
    """Features counted one by one, and the network's formula."""
    rnd = random.Random(10)
    docs = [(i, prose(rnd, rnd.choice(list(SYLLABLES)), rnd.choice([10, 60])) if i % 3 else "A! " * 20) for i in range(90)] + [(200, None), (201, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 90, 2)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    w = quality.fitted(d, q, langid.fold(F.col("doc_id")) != 1, steps=100)
    got = {r.doc_id: r.score for r in quality.scored(d, q, steps=100).collect()}

    def shares(codes):
        out = np.zeros(quality.HASHED)
        for c in codes:
            out[(c * 0x9E3779B97F4A7C15 % 2**64) >> 57] += 1 / len(codes)
        return out**0.5

    for i, text in docs:
        data, words = (text or "").encode(), (text or "").split()
        x = np.concatenate([quality.statistics(text), shares([a << 8 | b for a, b in zip(data, data[1:])]), shares([int(quality.word_hashes([s])[0]) for s in words])])
        z = np.clip((x - w["shift"]) / w["scale"], -6, 6) * np.where(np.arange(len(x)) < len(quality.NAMES), 1, quality.DAMPED)
        out = np.tanh(z @ w["A"] + w["a"]) @ w["v"] + w["b"][0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-out)), abs=1e-3)


def test_few_rows_and_a_repeated_id(spark):
    d = spark.createDataFrame([(0, "good text")] * 50 + [(2, "other !!"), (3, "more")], "doc_id long, text string")
    got = quality.scored(d, spark.createDataFrame([(0, 1)], "doc_id long, quality int"), sample=5, steps=30).collect()
    assert len(got) == 52 and all(0 <= r.score <= 1 for r in got)
