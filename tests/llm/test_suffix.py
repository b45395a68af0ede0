import hashlib
import random

import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import suffix  # noqa: E402


def brute(texts, length=200):
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        n = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(11)
    fresh = lambda n: "".join(rnd.choice("abcdé fgh\n") for _ in range(n))
    passages = [fresh(n) for n in (199, 200, 201, 230, 400, 900)]
    texts = []
    for _ in range(50):
        t = fresh(rnd.choice([0, 50, 300, 700]))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(60)
            t += (p[a:] if rnd.random() < 0.4 else p[: len(p) - a]) + fresh(rnd.choice([0, 3, 120]))
        if rnd.random() < 0.3 and t:
            i = rnd.randrange(len(t))
            t = t[:i] + "#" + t[i + 1 :]
        texts.append(t)
    whole = fresh(1000)
    texts += [whole, whole, whole[:500] + "!" + whole[501:], "ab" * 300, "x" * 450, "x" * 199, "x" * 200, "", None, fresh(260) * 2]
    return texts


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_matches_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    texts = corpus()
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicated(df).collect()}
    want = dict(enumerate(brute([(t or "").encode() for t in texts])))
    assert got == want
    assert any(w[1] and w[1] < w[0] for w in want.values())


def test_empty_table(spark):
    assert suffix.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranks_tell_strings_apart():
    import numpy as np

    data = np.frombuffer("".join(random.Random(4).choice("ab") for _ in range(3000)).encode(), np.uint8)
    for length in (1, 2, 3, 41, 64, 65, 200, 359):
        k = 1 if length == 1 else suffix.power(length)
        places = np.arange(len(data) - length + 1)
        rank = suffix.at_length(suffix.doubled(data, k), k, length, (places,))
        strings = [data[i : i + length].tobytes() for i in places]
        assert len(set(strings)) == len(set(rank.tolist())) == len(set(zip(strings, rank.tolist())))


def test_nulls_repeats_and_a_hot_passage(spark):
    rnd = random.Random(6)
    fresh = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    hot = fresh(500)
    texts = [fresh(150) + hot + fresh(rnd.randint(0, 90)) for _ in range(1500)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (None, None, 1), (7, "", 1)]
    got = sorted(suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, rid int")).collect(), key=str)
    want = brute([(t or "").encode() for _, t, _ in rows])
    assert sorted((tuple(r) for r in got), key=str) == sorted(((d, *w) for (d, _, _), w in zip(rows, want)), key=str)
