import itertools
import random

import numpy as np
import pytest
import xxhash

pytest.importorskip("quillspark.llm")
from quillspark.llm import simhash  # noqa: E402
from quillspark.llm.components import components  # noqa: E402


def brute_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, distance=2):
    """fps: list of (doc_id, fingerprint)."""
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= distance:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: find(d) for d, _ in fps}


def test_fingerprint_matches_definition():
    for text in (None, "", " \t\n", "A", "a b", "a b c", "Ä b c d  E\x0bf g", "x " * 1000, "aB aB ab AB"):
        assert simhash.fingerprint(text.encode() if text is not None else None, 3) == brute_fingerprint(text)


def test_code_is_perfect_and_near_pairs_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    h = simhash.home(x)
    assert (simhash.home(h) == h).all()
    assert np.bitwise_count(h ^ x).max() <= 7
    for e in range(3):
        y = x.copy()
        for _ in range(e):
            y ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
        a, b = simhash.home(simhash.near(x, 1)), simhash.home(simhash.near(y, 1))
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("cell", [64, 2])
def test_components_match_brute_force(spark, cell):
    rnd = random.Random(3)
    fps = []
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            fps.append(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    fps = list(enumerate(fps))
    want = brute_components(fps)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    values = {signed(f) for _, f in fps}
    edges = simhash.links(spark.createDataFrame([(0, v) for v in values], "s int, fp long"), 2, cell=cell).select("u", "v")
    root = {r.node: r.root for r in components(edges).collect()}
    groups = {}
    for d, f in fps:
        groups.setdefault(root.get(signed(f), signed(f)), []).append(d)
    assert {d: min(g) for g in groups.values() for d in g} == want


def test_near_duplicates_edge_cases(spark):
    rows = [(1, "one two three four five", 9), (2, "ONE two three four\nfive", 9), (3, None, 9), (4, "", 9), (5, " \t", 9), (6, "quite another text here", 9), (6, "quite another text here", 9), (None, "one two three four five", 9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[None].component_id == 1
    assert by[3].component_id == by[4].component_id == by[5].component_id == 3 and by[3].fingerprint == "0" * 16
    assert by[6].component_id == 6
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_fingerprint_of_very_many_rows(spark):
    rows = [(i, "" if i % 2 else None) for i in range(1500)] + [(2000 + i, f"word{i} and some more words of {i * 7}") for i in range(40)] + [(1999, "word3 and some more words of 21")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows[1499:]])
    assert len(got) == len(rows) and {got[i].component_id for i in range(1500)} == {0}
    assert {d: got[d].component_id for d in want if d >= 1999} == {d: c for d, c in want.items() if d >= 1999}
