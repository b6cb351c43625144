"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from candor.llm import spelling_variants as sv

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edit_is_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if edit_is_one(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def made(seed, letters="abcé", n=250):
    """Words over few letters, many of them an edit apart, with counts over several powers of five."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), rng.integers(5, 9))) for _ in range(n)]
    words += [w[:k] + w[k + 1 :] for w in words for k in [int(rng.integers(0, len(w)))]] + ["aaaaaaa", "aaaaaa", "aaaaaaaa"]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(words[int(len(words) * rng.random() ** 4)] for _ in range(60))))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: r[0]
    return sorted((tuple(r) for r in sv.variants(df.repartition(3), **options).collect()), key=key)


@pytest.mark.parametrize("options", [{}, {"hot": 4}, {"parts": 3}, {"parts": 7}])
def test_against_brute_force(spark, options):
    rows = made(1)
    got = run(spark, rows, **options)
    assert got == plain(rows)
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_other_letters(spark):
    rows = made(2, "aÉéßz", 120)
    assert run(spark, rows) == plain(rows)


def test_every_pair_at_one_edit_shares_a_signature(spark):
    rng = np.random.default_rng(7)
    words = {"".join(rng.choice(list("abcdefghé"), rng.integers(6, 14))) for _ in range(150)}
    for w in list(words):
        k, c = int(rng.integers(0, len(w))), str(rng.choice(list("abcdefghé")))
        words |= {w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = {(r["word_1"], r["word_2"]) for r in sv.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and edit_is_one(a, b)}


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "12 34 ×÷ \U00020000"), (None, "Wörter wörter WÖRTER wörter " * 5), (3, "längere " * 6 + "x" * 50_000), (3, "längere " * 6), (4, "langere " * 30 + "langer " * 5)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abcdef " * 5, "x", 2)], "doc_id long, text string, word string, N long")
    assert [tuple(r) for r in sv.variants(df).collect()] == [("abcdef", None, "abcdef", 5, 0, None)]
