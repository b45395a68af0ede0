import math
import random

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from pyspark.sql import functions as F  # noqa: E402
from quillspark.llm import chat, decontam, mixing, topk  # noqa: E402


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    vecs += [(300 + i, vecs[0][1]) for i in range(30)]
    vecs += [(400, None), (401, []), (402, [1.0, None, 2.0]), (403, [math.nan] * 8), (404, [math.inf] * 8), (None, [1.0] * 8), (405, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = {i: np.floor(64 * np.array(v)) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q, x in ok.items():
        if q % 20 == 0:
            s = sorted((-int(x @ y), c) for c, y in ok.items() if c != q and len(y) == len(x))[:7]
            want[q] = [(n + 1, c, -v) for n, (v, c) in enumerate(s)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 192 - 128 * 256)]


def test_rotation_shows_every_perspective(spark):
    rows = [(1, 0, "system", "S", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", None, 0), (1, 3, "ann", "bye", 0), (1, None, None, "?", 0), (2, 0, "system", "x", 0), (None, 0, "ann", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name int")
    for chunk in (1, 256):
        got = chat.rotate_perspectives(df, chunk=chunk).orderBy("perspective", "seq").collect()
        for who in ("ann", "bob"):
            own = [r for r in got if r.perspective == who]
            whole = "".join(r.segment for r in own)
            assert [r.seq for r in own] == [0, 1, 2, 3, 4]
            assert [whole[r.mask_start : r.mask_end] for r in own if r.trained] == [f"{t or ''}<|im_end|>" for _, _, s, t, _ in rows[:5] if s == who]
            assert all(r.mask_start == r.mask_end for r in own if not r.trained)
        assert got[1].segment == "<|im_start|>assistant\nhi<|im_end|>\n" and got[6].segment == "<|im_start|>user name=ann\nhi<|im_end|>\n"
        assert len(got) == 10
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def brute_contained(docs, items, words=5, least=0.8):
    out = set()
    for d, t in docs:
        w = decontam.words_of(t)
        for i, s in items:
            v = decontam.words_of(s)
            if v:
                n = min(words, len(v))
                a = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
                b = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                if len(a & b) >= least * len(a):
                    out.add((d, i, len(a), len(a & b)))
    return out


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_containment_matches_brute_force(spark, block_words):
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 15, 40])))) for i in range(40)] + [(40, None), (41, ""), (42, "..."), (None, "uu vv ww uu vv")]
    docs = [(50, "UU, vv ww uu VV!"), (51, None), (52, "")]
    for d in range(50):
        text = [word() for _ in range(rnd.choice([3, 30, 600]))]
        for i in rnd.sample(range(40), 3):
            w = items[i][1].split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "zz"
            at = rnd.randrange(len(text))
            text[at:at] = w
        docs.append((d, " ".join(text)))
    got = decontam.contaminated(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == brute_contained(docs, items)
    assert decontam.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_targets_fill_up_to_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got["a"] == 30 and abs(sum(got.values()) - 1810) < 1e-9
    level = got["b"] / 2
    assert abs(got["c"] - level) < 1e-9 and abs(got[None] - min(900, 5 * level)) < 1e-9


def test_targets_of_many_sources_over_several_ranges(spark):
    rnd = random.Random(9)
    sizes = {**{f"http://h/{rnd.random()}": rnd.choice([0, 1, 7, 7, rnd.randint(1, 10**6)]) for _ in range(400)}, None: 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # would make one range of few rows
    try:
        got = {r.source: (r.kind, r.target) for r in mixing.source_targets(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    free, left = set(names), sum(sizes.values())
    while over := {s for s in free if 3 * sizes[s] <= left / sum(weight[x] for x in free) * weight[s]}:
        free -= over
        left -= sum(3 * sizes[s] for s in over)
    for i, s in enumerate(names):
        want = left / sum(weight[x] for x in free) * weight[s] if s in free else 3 * sizes[s]
        assert got[s][0] == i % 3 and abs(got[s][1] - want) < 1e-6 * max(1, want)
    assert mixing.source_targets(df.limit(0)).count() == 0


def test_mix_meets_targets_and_schedules(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", "d", None]), " ".join("w" * rnd.randint(0, 40)), 0) for i in range(800)] + [(None, "a", None, 0), (5000, "e", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix_plan(df, bucket_rows=32).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by.setdefault((r.target, r.source), []).append(r)
    for (target, _), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= 20
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_plan(df.repartition(7), bucket_rows=500).collect()), key=str)
    order = mixing.training_order(df).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    early = [r for r in order if r.source == "a"]
    assert sum(r.position < 0.5 for r in early) > 0.55 * len(early)  # the first source's schedule falls
    assert mixing.mix_plan(df.limit(0)).count() == 0 and mixing.training_order(df.limit(0)).count() == 0


def test_scores_beyond_longs_are_the_greatest_long(spark):
    from quillspark.llm import topk

    big = 2.0**40
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (3, [1.0, 2.0]), (4, [big / 4, 0.0]), (5, [2.0**-3, 5.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    top = 2**63 - 1
    whole = {i: [int(64 * v) for v in e] for i, e in rows}
    score = {i: max(-top - 1, min(top, sum(a * b for a, b in zip(whole[0], whole[i])))) for i in whole if i}
    want = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:4]
    assert [(r.vec_id, r.score) for r in got] == want and want[0][1] == top == want[1][1]
