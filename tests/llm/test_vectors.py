"""Permutation index and projection forest against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.llm import permutation_index as pi
from candor.llm import rp_forest as rf

ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0, None] + [0.0] * 14, 1), (9004, [float("nan")] + [1.0] * 15, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [], 1)]


def clustered(n=900, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    for start in range(0, 300, 10):  # near copies in groups of ten
        v[start : start + 10] = v[start] + rng.normal(scale=0.05, size=(10, dim))
    v[400:420] = v[400]  # exact copies
    return v


def frame(spark, v, labels):
    rows = [(i, [float(x) for x in r], int(l)) for i, (r, l) in enumerate(zip(v, labels))]
    return spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("old")).repartition(4)


def test_nearest_recall_and_order(spark, monkeypatch):
    v = clustered()
    df = frame(spark, v, np.zeros(len(v)))
    monkeypatch.setattr(pi, "PASS_BYTES", 4096)  # several passes
    ranked = []
    plain = pi.Segment.candidates
    monkeypatch.setattr(pi.Segment, "candidates", lambda self, order: ranked.append(1) or plain(self, order))
    part = pi.Segment(np.arange(len(v)), v, pi.pivot_orders(v, v[:64], 64), 64)
    assert part.most < len(v) / 2 and len(part.candidates(pi.pivot_orders(v[:1], v[:64], 64)[0])) == part.most and ranked
    got = pi.nearest(df, F.col("vec_id") % 10 == 0, pivots=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(by) == set(range(0, 900, 10))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        far = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert all(abs(far[i] - d) < 1e-12 and i != q for _, d, i in found)
        far[q] = np.inf
        hits += len({f[2] for f in found} & set(np.lexsort((np.arange(900), far))[:10]))
    assert hits >= 0.9 * 10 * len(by)


def test_nearest_of_few_rows_and_lengths(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (200, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in pi.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 2, 2**0.5), (100, 2, 3, 2**0.5), (200, 1, 7, 1.0)]
    assert pi.nearest(df.limit(0), F.lit(True)).count() == 0
    assert pi.nearest(df, F.lit(False)).count() == 0


def test_nearest_does_not_depend_on_the_layout(spark, monkeypatch):
    v = clustered()
    df = frame(spark, v, np.zeros(len(v)))
    build = pi.build_index
    monkeypatch.setattr(pi, "build_index", lambda d, p: build(d, p, segment=150))  # several segments
    got = [sorted(map(tuple, pi.nearest(df.repartition(n), F.col("vec_id") % 50 == 0, pivots=64).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 10 * 18


def test_nearest_of_one_row_that_stands_very_often(spark):
    rows = [(1, [1.0, 0.0])] * 500 + [(100, [1.0, 0.1]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in pi.nearest(df, F.col("vec_id") == 100).orderBy("rank").collect()]
    assert got == [1] * 10
    chosen = pi.choose_pivots(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    assert len(chosen) == 3


def brute(v, labels, threshold):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    part = np.arange(len(v))
    while True:
        low = np.where(near, part[None, :], len(v)).min(1)
        new = np.minimum(part, low)
        if (new == part).all():
            return near.sum(1), part
        part = new


@pytest.mark.parametrize("leaf_rows", [1024, 64])
def test_links_and_components(spark, leaf_rows):
    v = clustered()
    labels = np.arange(len(v)) // 450
    got = rf.near_duplicates(frame(spark, v, labels), leaf_rows=leaf_rows).select("vec_id", "n_links", "component_id", "kept").collect()
    assert len(got) == len(v) + len(ODD)
    links, part = brute(v, labels, 0.93)
    found = {r["vec_id"]: r for r in got}
    exact = sum(found[i]["n_links"] == n and found[i]["component_id"] == p for i, (n, p) in enumerate(zip(links, part)))
    assert exact >= (1.0 if leaf_rows == 1024 else 0.97) * len(v)
    assert all(found[i]["n_links"] <= n for i, n in enumerate(links))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert all(found[o[0]]["n_links"] == 0 and found[o[0]]["kept"] for o in ODD)


def test_unsplittable_cells_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rf, "LEVELS", 0)
    monkeypatch.setattr(rf, "fit_tree", lambda *a: {})
    rng = np.random.default_rng(2)
    v = np.ones((90, 8)) + rng.normal(scale=1e-3, size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = rf.near_duplicates(df, leaf_rows=32, trees=2).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(89, 0)}


def test_odd_labels_and_empty(spark):
    rows = [(1, [1.0, 0.0], None), (2, [1.0, 0.0], None), (3, [1.0, 0.0], 5), (4, [1.0, 0.0], 5), (4, [1.0, 0.0], 5), (None, [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(repr, [(r["vec_id"], r["n_links"], r["component_id"]) for r in rf.near_duplicates(df).collect()]))
    assert got == sorted(map(repr, [(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (4, 2, 3), (None, 0, None)]))
    assert rf.near_duplicates(df.limit(0)).count() == 0


def test_group_of_several_leaves_is_whole(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 64))
    middle = rng.normal(size=(3, 64))
    v[:500] = middle[0] / np.linalg.norm(middle[0]) + rng.normal(scale=0.2 / 8, size=(500, 64))  # cosines about 0.96
    v[500:700] = middle[1] / np.linalg.norm(middle[1]) + rng.normal(scale=0.1 / 8, size=(200, 64))  # all link
    v[700:900] = v[0] + rng.normal(scale=0.3 / 8, size=(200, 64))  # rim of the first group: some links
    v[900:1000] = middle[2] / np.linalg.norm(middle[2]) + rng.normal(scale=0.27 / 8, size=(100, 64))  # about half link
    labels = (np.arange(len(v)) % 50 == 0).astype(int)
    got = rf.near_duplicates(frame(spark, v, labels), leaf_rows=64).collect()
    links, part = brute(v, labels, 0.93)
    found = {r["vec_id"]: r for r in got}
    assert len(got) == len(v) + len(ODD) and links.sum() > 250_000
    assert [found[i]["n_links"] for i in range(900)] == links[:900].tolist()
    assert sum(found[i]["n_links"] for i in range(len(v))) >= 0.999 * links.sum()
    assert all(found[i]["component_id"] == part[i] for i in range(900))
