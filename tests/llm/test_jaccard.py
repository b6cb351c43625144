"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from candor.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(a):
        while part[a] != a:
            a = part[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                part[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(map(repr, [(k, len(s), low.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]))


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(40)
    rows = []
    for base in range(12):
        words = make(rng.randrange(20, 160))
        for _ in range(rng.randrange(1, 14)):  # near copies around the threshold
            copy = list(words)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    for _ in range(60):  # texts that share little but a passage
        rows.append(" ".join(make(rng.randrange(0, 25)) + passage + make(rng.randrange(0, 25))))
    rows += [" ".join(make(rng.randrange(1, 60))) for _ in range(60)]
    rows += ["A b\tC", "a B c", "a b c d", "", " \n", None, "ONE two\x0bthree FOUR five", "one TWO three four five", "z" * 300_000]
    rows += ["repeated words " * 50] * 5 + ["repeated words " * 51]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, "a b c"), (None, None), (None, "alone here"), (5, rows[5])]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:  # blocks, leaders, common shingles and buckets all come into play
        for name, value in {"BLOCK_ROWS": 4, "BUCKET": 500, "LOCAL_REPEATS": 2, "COMMON": 50, "WIDE": 3}.items():
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, component_id string, N_SHINGLES int")
    got = jaccard.jaccard_components(df.repartition(4))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(repr, [tuple(r) for r in got.collect()])) == expected(rows)


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(blank).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_sets_equal_brute_force():
    texts = [t for _, t in corpus(9)]
    ours, theirs = jaccard.shingle_sets(texts), [shingles(t) for t in texts]
    assert [len(a) for a in ours] == [len(b) for b in theirs]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(ours[i], ours[j])) == len(theirs[i] & theirs[j])


def test_overlaps_of_a_block():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    got = jaccard.overlaps(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
