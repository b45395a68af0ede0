import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import keyness, resample, vectors
from quillspark.plans import analyses


def unit(rng, n, shift=0.0):
    x = rng.normal(size=(n, 6)) + shift
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute_energy(x, y):
    x, y = x.astype(float), y.astype(float)
    d = lambda a, b: math.sqrt(max(0, 2 - 2 * float(a @ b)))
    mean = lambda v: sum(v) / len(v)
    within = lambda z: mean([d(z[i], z[j]) for i in range(len(z)) for j in range(i + 1, len(z))])
    return max(0.0, 2 * mean([d(a, b) for a in x for b in y]) - within(x) - within(y))


def frame(spark, sets):
    rows, i = [], 0
    for name, z in sets.items():
        for v in z:
            rows.append(("q1", name, i, [float(a) for a in v]))
            i += 1
    return spark.createDataFrame(rows, "question string, dataset string, id long, embedding array<float>")


def test_energy_distance_in_both_forms(spark):
    rng = np.random.default_rng(0)
    sets = {"human": unit(rng, 12), "far": unit(rng, 9, 2.0), "same": None, "one": unit(rng, 1)}
    sets["same"] = sets["human"].copy()
    df = frame(spark, sets)
    a = {r.dataset: r.value for r in vectors.energy_distance(df).collect()}
    b = {r.dataset: (r.value, r.p) for r in vectors.permutation_test(df, n=200).collect()}
    small = {r.dataset: r.value for r in vectors.energy_distance(df.unionByName(df.limit(1).withColumn("embedding", F.lit(None).cast("array<float>"))), block=3).collect()}
    assert small == {k: None if x is None else pytest.approx(x, abs=1e-9) for k, x in a.items()}
    assert vectors.energy_distance(df.limit(0)).count() == 0
    assert a["far"] == pytest.approx(brute_energy(sets["human"], sets["far"]), abs=1e-9) == pytest.approx(b["far"][0], abs=1e-9)
    assert a["same"] == b["same"][0] == 0 and a["one"] is None and b["one"] == (None, None)
    assert b["far"][1] == pytest.approx(1 / 201) and b["same"][1] > 0.5
    with pytest.raises(Exception, match="at most 5"):
        vectors.permutation_test(df, most=5).collect()


def test_label_algebra_equals_the_loop():
    rng = np.random.default_rng(3)
    z = unit(rng, 11).astype(float)
    s = vectors.shuffles([f"1|{i}" for i in range(11)], 4, 20, 1, "permutation", ["q1", "far"])
    got = vectors.statistics(vectors.distances(z), s)
    assert all(s.sum(axis=0) == 4)
    for k in range(20):
        assert got[k] == pytest.approx(brute_energy(z[s[:, k] == 1], z[s[:, k] == 0]), abs=1e-9)


def test_halves_are_disjoint_and_exhaustive(spark):
    ids = spark.createDataFrame([("q", i) for i in range(7)], "question string, respondent_id long")
    got = resample.split_halves(ids, n=30).groupBy("rep", "half").agg(F.collect_set("respondent_id").alias("s")).collect()
    by = {(r.rep, r.half): set(r.s) for r in got}
    assert all(len(by[r, "A"]) == 3 and by[r, "A"] | by[r, "B"] == set(range(7)) and not by[r, "A"] & by[r, "B"] for r in range(30))
    assert len({frozenset(by[r, "A"]) for r in range(30)}) > 5


def test_bootstrap_draws_a_set_or_a_multiset(spark):
    df = spark.createDataFrame([("q", "human", i, f"k{i % 4}") for i in range(12)] + [("q", "few", i, "k") for i in range(3)], "question string, dataset string, respondent_id long, key string")
    plain = resample.bootstrap_entropy(df, n=25).collect()
    multi = resample.bootstrap_entropy(df, n=25, multiplicity=True).collect()
    assert len(plain) == len(multi) == 25 and {r.dataset for r in plain} == {"human"}
    assert all(0 <= r.entropy <= 1 for r in plain + multi) and sorted(r.entropy for r in plain) != sorted(r.entropy for r in multi)


def test_keyness_floor_counts_rare_tokens(spark):
    rows = [("q", "human", ["casa"] * 9 + ["raro"] * 4), ("q", "x", ["scuola"] * 8 + ["casa"]), ("q", "x", [])]
    kdf = keyness.log_odds(keyness.token_counts(spark.createDataFrame(rows, "question string, dataset string, tokens array<string>")))
    got = {r.token: r for r in kdf.collect()}
    assert set(got) == {"casa", "scuola"}
    a, na, nb, v = 0.01, 13, 9, 3
    logit = lambda c, n: math.log((c + a) / (n + a * v) / (1 - (c + a) / (n + a * v)))
    diff = logit(8, nb) - logit(0, na)
    assert got["scuola"].log_odds == pytest.approx(diff) and got["scuola"].z == pytest.approx(diff / math.sqrt(1 / 8.01 + 1 / 0.01))
    assert keyness.top_terms(kdf).count() == 1
    empty = keyness.log_odds(keyness.token_counts(spark.createDataFrame([], "question string, dataset string, tokens array<string>")))
    assert empty.count() == 0 and "p_adj" in empty.columns


def shuffled_energy(z, base, labels, head, n, size):
    """The statistic of each shuffle, by the loop."""
    out = []
    for r in range(n):
        order = sorted(range(len(z)), key=lambda j: (hashlib.md5(f"42|{head}|{r}|{labels[j]}".encode()).hexdigest(), labels[j]))
        out.append(brute_energy(z[order[:size]], z[order[size:]]))
    return brute_energy(z[base == 1], z[base == 0]) if 0 < base.sum() < len(z) else None, out


def test_permutations_in_blocks_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    z = unit(rng, 23)
    base = np.array([1] * 9 + [0] * 14)
    rows = [("q1", "far", int(b), str(i), [float(a) for a in v]) for i, (b, v) in enumerate(zip(base, z))]
    df = spark.createDataFrame(rows, "question string, dataset string, base int, i string, e array<float>")
    seen, values = shuffled_energy(z, base, [f"{b}|{i}" for i, b in enumerate(base)], "permutation|q1|far", 90, 9)
    for block in (4, 100):
        got = vectors.resampled_energy(df, ["question", "dataset"], 90, 42, "permutation", block=block).first()
        assert (got.n1, got.n2) == (9, 14) and list(got["values"]) == pytest.approx([seen, *values], abs=1e-9)


def many(spark, n):
    """2 n vectors of one question, half of them the baseline's."""
    e = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.sin(F.col("id") * k) / 2).cast("float"))
    return spark.range(2 * n).select(F.lit("q1").alias("question"), F.when(F.col("id") % 2 == 0, "human").otherwise("far").alias("dataset"), "id", e.alias("embedding"))


def test_permutations_of_more_vectors_than_a_task_holds(spark):
    got = vectors.permutation_test(many(spark, 3100), n=3).collect()
    assert len(got) == 1 and got[0].value >= 0 and got[0].p >= 0.25


def test_bootstrap_equals_the_loop_and_rows_are_no_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 8)
    ids = [f"r{i:02d}" for i in range(21)]
    rows = [("q", "human", d, f"k{(i * j) % 5}" if (i + j) % 4 else None) for i, d in enumerate(ids) for j in range(i % 3 + 1)]
    df = spark.createDataFrame([*rows, ("q", None, "r00", "k0")], "question string, dataset string, respondent_id string, key string")
    for multiplicity in (False, True):
        frame = resample.bootstrap_entropy(df, n=7, multiplicity=multiplicity)
        got = {r.rep: r.entropy for r in frame.collect()}
        for rep in range(7):
            picks = [int(hashlib.md5(f"42|bootstrap|q|human|{rep}|{s}".encode()).hexdigest()[:8], 16) % 21 for s in range(21)]
            times = collections.Counter(picks)
            c = collections.Counter()
            for _, _, d, k in rows:
                if k is not None:
                    c[k] += min(times[ids.index(d)], 9 if multiplicity else 1)
            c = [x for x in c.values() if x]
            assert got[rep] == pytest.approx(-sum(x / sum(c) * math.log(x / sum(c)) for x in c) / math.log(len(c)), abs=1e-9)
        # a draw was a row of a shuffle: ids times repetitions
        assert "PythonMapInPandas" in frame._jdf.queryExecution().toString() or "MapInPandas" in frame._jdf.queryExecution().toString()


def test_split_half_means_equal_the_loop(spark):
    rows = [("q", f"r{i:04d}", float(i * i % 7) if i % 5 else None) for i in range(3001)] + [("few", f"r{i}", float(i)) for i in range(3)] + [("q", "r0001", 2.5), (None, "r0001", 9.0)]
    df = spark.createDataFrame(rows, "question string, respondent_id string, value double")
    frame = resample.split_half_mean(df, n=6)
    got = {(r.question, r.rep): r.value for r in frame.collect()}
    assert len(got) == 12
    for (q, rep), value in got.items():
        ids = sorted({d for k, d, _ in rows if k == q}, key=lambda d: hashlib.md5(f"42|split|{q}|{rep}|{d}".encode()).hexdigest())
        first = set(ids[: len(ids) // 2])
        mean = lambda side: np.mean([v for k, d, v in rows if k == q and v is not None and (d in first) == side])
        assert value == pytest.approx(mean(True) - mean(False), abs=1e-9)
    # what is ranked are the ids around the middle, not every id once for each repetition
    assert "CartesianProduct" not in (plan := frame._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan


def test_halves_of_more_vectors_than_a_task_holds(spark):
    got = vectors.split_half_energy(many(spark, 3100).drop("dataset"), n=3).collect()
    assert sorted(r.rep for r in got) == [0, 1, 2] and all(0 <= r.value < 0.01 for r in got)


def test_both_forms_agree_on_more_vectors_than_a_task_holds(spark):
    df = many(spark, 3100)
    assert vectors.permutation_test(df, n=1).first().value == pytest.approx(vectors.energy_distance(df).first().value, abs=1e-9)


def test_subgroups_of_more_vectors_than_a_task_holds(spark):
    df = many(spark, 3100).withColumn("respondent_id", F.col("id"))
    people = df.select(F.lit("human").alias("dataset"), "respondent_id", F.lit("Sostegno").alias("ruolo_2"), F.lit(None).cast("string").alias("grado_2"), F.lit(None).cast("string").alias("esperienza_2"))
    tests = analyses.subgroup_analyses(people, {"embeddings": df})["embedding_fidelity"].collect()
    assert [(r.bin, r.question, r.dataset) for r in tests] == [("Sostegno", "q1", "far")] and tests[0].p_adj <= 1


def test_entropy_delta_makes_no_row_of_a_draw(spark):
    rows = [("q", d, i, f"k{i % k}") for d, k in (("human", 4), ("gpt", 3)) for i in range(12)]
    out = analyses.entropy_delta(spark.createDataFrame(rows, "question string, dataset string, respondent_id long, key string"), n=20)
    assert "bootstrap" in (plan := out._jdf.queryExecution().toString()) and "md5(" not in plan
    assert [(r.dataset, r.value) for r in out.collect()] == [("gpt", pytest.approx(0, abs=1e-9))]
