import itertools
import random
import re

import pytest

pytest.importorskip("quillspark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quillspark.llm import decontam, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rnd = random.Random(9)
    syllables = {"en": "the and ing ion ent er", "de": "der die ung sch ich au"}
    prose = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang].split()) for _ in range(rnd.randint(2, 4))) for _ in range(n))
    items = [(i, prose("en", 20)) for i in range(4)]
    rows = []
    for i in range(60):
        lang = rnd.choice(["en", "de"])
        rows.append([i, prose(lang, rnd.choice([60, 150, 400])), lang, f"s{i % 3}"])
    for i in range(60, 70):  # near copies: a word or two replaced
        w = rows[i - 60][1].split()
        w[rnd.randrange(len(w))] = "edited"
        rows.append([i, " ".join(w), rows[i - 60][2], "s9"])
    rows += [[70, rows[20][1], rows[20][2], "s0"], [71, rows[20][1], rows[20][2], None]]
    rows.append([72, prose("en", 100) + " " + items[1][1] + " " + prose("en", 50), "en", "s1"])
    rows.append([73, items[2][1].upper().replace(" ", ", "), "en", "s1"])
    rows.append([74, prose("en", 80) + " write to ann.lee@mail.example.com or 17.252.227.210", "en", "s2"])
    rows += [[75, None, "en", "s1"], [76, "", "de", "s1"], [77, "123 456 !!", "en", "s1"], [None, prose("de", 90), "de", "s2"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows], items


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    """Ids that stay if texts of similarity 0.8 or more are linked: the smallest of each group."""
    ids = [r[0] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(r[1]) for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[b] = a
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()}


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "language_id":
            assert {r.doc_id for r in before} - set(after) == {75, 76, 77}
        elif name == "simhash_dedup":
            assert set(after) == brute_kept([(r.doc_id, r.text) for r in before])
        elif name == "decontaminate":
            sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (decontam.words_of(t) for _, t in items)]
            own = lambda t: {tuple(w[i : i + 5]) for w in [decontam.words_of(t)] for i in range(len(w) - 4)}
            assert {r.doc_id for r in before} - set(after) == {r.doc_id for r in before if any(len(s & own(r.text)) >= 0.8 * len(s) for s in sets)} == {72, 73}
        else:
            for r in before:
                assert (after[r.doc_id].text == r.text) == (r.doc_id != 74)
            assert re.search(r" write to \w+\.\w+@\w+\.\w+\.com or \d+\.\d+\.\d+\.\d+$", after[74].text) and "ann.lee" not in after[74].text and "17.252" not in after[74].text
            assert after[74].n_chars == len(after[74].text)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in after.values()}
    assert [r.position for r in got] == sorted(r.position for r in got) and all(r.text == texts[r.doc_id] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.size)
    assert all(abs(sum(s) - target) <= max(s) for (_, target), s in by.items())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, got), key=str)


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_resemblance_is_exact_for_small_sets():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 5, 60):
        a, b = (np.unique(rng.integers(0, 90, n)).astype("<u4") for _ in range(2))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if n else 1.0
        assert simhash.resemblance(a.tobytes(), b.tobytes()) == pytest.approx(want)


def near_copies(kinds, n=12, seed=3):
    """Texts and copies of these that differ in one block or in scattered words, at similarities
    from about 0.7 to 0.95."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for kind in kinds:
        for i in range(n):
            w = [word() for _ in range(rnd.choice([60, 200, 900, 3000]))]
            block = [word() for _ in range(int(len(w) * (0.05 + 0.35 * i / n)))]
            copy = {"appended": w + block, "prepended": block + w, "truncated": w[: len(w) - len(block) * 2 // 3], "inserted": w[: len(w) // 3] + block + w[len(w) // 3 :]}
            if kind == "scattered":
                c = list(w)
                for j in rnd.sample(range(len(c)), max(1, len(block) // 12)):
                    c[j] = word()
                copy[kind] = c
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(copy[kind]))]
    return rows


def test_near_copies_however_they_differ(spark):
    rows = near_copies(["appended", "prepended", "truncated", "inserted", "scattered"])
    got = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_kept(rows)
    assert {r.doc_id for r in got} == want and len(rows) / 2 < len(want) < len(rows) - 20


def test_copies_among_texts_of_the_same_words(spark):
    """Shuffled lines of one text have equal fingerprints over words, and all share some shingles."""
    rnd = random.Random(5)
    lines = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(8)) for _ in range(20)]
    rows = []
    for _ in range(60):
        own = lines[:]
        rnd.shuffle(own)
        rows.append((len(rows), "\n".join(own)))
        if len(rows) % 3 == 1:  # the last line left out
            rows.append((len(rows), "\n".join(own[:-1])))
    got = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_kept(rows)
    assert {r.doc_id for r in got} == want and len(rows) > len(want) > 50


def test_large_group_of_near_copies(spark):
    """Copies of one text with edits of their own: many are similar to each other, few to all; and a
    column named like one that the operator makes stays."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rnd.sample(range(len(w)), rnd.choice([1, 2, 3, 4])):
            w[j] = word()
        rows.append((i, " ".join(w), i))
    got = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, _rid int"))
    assert got.columns == ["doc_id", "text", "_rid"] and {r.doc_id for r in got.collect()} == brute_kept(rows)


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    """130 million characters of filler beside the texts whose shingles are counted."""
    from collections import Counter

    from pyspark.sql import functions as F

    texts = [" ".join(f"w{j}" for j in range(i % 7, 30 + i % 11)) for i in range(50)] + [None, "", "one word", "in two texts", "in two texts"]
    filler = spark.range(400).select(F.expr("repeat(concat(repeat('x', 999), ' '), 325)").alias("text"))
    few = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = filler.unionByName(few).select(F.monotonically_increasing_id().alias("rid"), "text")
    want = Counter(h for t in texts for h in simhash._shingles(t, 5).tolist())
    want[simhash._shingles(" ".join(["x" * 999] * 9), 5).item()] = 400
    assert 2 in want.values()

    def got():
        h, n = simhash.common_shingles(rows, 5)
        assert h.tolist() == sorted(h.tolist())
        return dict(zip(h.tolist(), n.tolist()))

    assert got() == {h: n for h, n in want.items() if n > 2}
    monkeypatch.setattr(simhash, "COMMON", 5)  # what shares a count stays or goes together
    least = min(m for m in set(want.values()) if sum(n >= m for n in want.values()) <= 5)
    assert got() == {h: n for h, n in want.items() if n >= least} and least > 3
