import datetime
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import vectors as vx
from candor.operators import blocks, campaigns, clusters, graph, overlap, pairs
from candor.session import cut_lineage, workspace


def sample(n=120, dim=8, seed=3, groups=6, copies=20):
    """Clustered unit-free vectors with exact copies of the first one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(groups, size=n)] + rng.normal(scale=0.35, size=(n, dim))
    v[:copies] = v[0]
    return v


def frame(spark, v, **extra):
    rows = [(str(i), [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "content_id string, embedding array<double>")


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def brute_pairs(v, t):
    c = cosines(v)
    return {tuple(sorted((str(i), str(j)))) for i, j in itertools.combinations(range(len(v)), 2) if c[i, j] >= t}


@pytest.mark.parametrize("block_rows", [4096, 16])
@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_pairs_equal_brute_force(spark, block_rows, threshold):
    v = sample()
    found = pairs.similar_pairs(frame(spark, v), threshold=threshold, block_rows=block_rows).collect()
    got = [(r["content_id_1"], r["content_id_2"]) for r in found]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert set(got) == brute_pairs(v, threshold)
    c = cosines(v)
    assert all(abs(r["similarity_score"] - c[int(r["content_id_1"]), int(r["content_id_2"])]) < 1e-9 for r in found)


def test_copies_are_folded(spark):
    v = sample(copies=60)
    _, found = pairs.similar_groups(frame(spark, v), threshold=0.9)
    assert found.count() < len(brute_pairs(v, 0.9)) / 2
    members, _ = pairs.similar_groups(frame(spark, v), threshold=0.9)
    assert members.where("rep = '0'").count() == 60


def test_zero_null_and_strict(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>")
    got = [(r[0], r[1]) for r in pairs.similar_pairs(df, threshold=1.0).collect()]
    assert got == [("a", "b")]
    assert pairs.similar_pairs(df, threshold=1.0, strict=True).count() == 0


def test_scope_restricts_pairs(spark):
    v = sample()
    df = frame(spark, v).withColumn("content_type", F.when(F.col("content_id").cast("int") % 2 == 0, "x").otherwise("y"))
    got = {(r[0], r[1]) for r in pairs.similar_pairs(df, threshold=0.8, scope="content_type", block_rows=16).collect()}
    assert got == {p for p in brute_pairs(v, 0.8) if int(p[0]) % 2 == int(p[1]) % 2}


def test_lsh_is_a_subset(spark):
    v = sample(copies=12)
    exact = brute_pairs(v, 0.9)
    for block_rows in (4096, 8):
        found = pairs.lsh_pairs(frame(spark, v), threshold=0.9, block_rows=block_rows).collect()
        got = {(r["content_id_1"], r["content_id_2"]) for r in found}
        assert len(got) == len(found) and got <= exact and len(got) >= 0.9 * len(exact)


def test_lsh_copies_share_all_links(spark):
    rows = [("a", [1.0, 0.2]), ("b", [1.0, 0.2]), ("c", [1.0, 0.21])]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>")
    got = {(r["content_id_1"], r["content_id_2"]) for r in pairs.lsh_pairs(df, threshold=0.9, recall=0.999).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}


def test_join_plan_has_no_cross_join(spark):
    found = pairs.similar_pairs(frame(spark, sample()), threshold=0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def brute_dbscan(v, t, m):
    near = np.round(cosines(v), 12) >= t
    n = len(v)
    core = [i for i in range(n) if near[i].sum() >= m]
    parent = {i: i for i in core}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(core, 2):
        if near[i, j]:
            parent[root(i)] = root(j)
    names = {}
    for i in core:
        names.setdefault(root(i), []).append(str(i))
    label = {i: min(names[root(i)]) for i in core}
    for i in set(range(n)) - set(core):
        around = [label[j] for j in core if near[i, j]]
        if around:
            label[i] = min(around)
    return {str(i): c for i, c in label.items()}


@pytest.mark.parametrize("block_rows", [4096, 16])
@pytest.mark.parametrize("threshold,samples", [(0.93, 3), (0.97, 4), (0.8, 2)])
def test_clusters_equal_brute_force(spark, block_rows, threshold, samples):
    v = sample(copies=6)
    members, found = clusters.semantic_clusters(
        frame(spark, v), threshold=threshold, min_samples=samples, block_rows=block_rows
    )
    got = {r["content_id"]: r["cluster"] for r in members.collect()}
    expected = brute_dbscan(v, threshold, samples)
    assert got == expected
    c = cosines(v)
    for r in found.collect():
        ids = [int(i) for i, k in expected.items() if k == r["cluster"]]
        assert r["cluster_size"] == len(ids)
        mean = np.mean([c[i, j] for i, j in itertools.combinations(ids, 2)])
        assert r["avg_similarity"] == pytest.approx(mean, abs=1e-9)


def test_components_and_triangles_with_a_hub(spark):
    rng = np.random.default_rng(5)
    edges = {(0, i) for i in range(1, 60)} | {tuple(sorted(map(int, rng.integers(100, 200, 2)))) for _ in range(90)}
    edges = {(a, b) for a, b in edges if a != b}
    name = lambda i: f"n{i:03d}"
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string")
    vertices = spark.createDataFrame([(name(i),) for i in range(210)], "id string")
    parent = list(range(210))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r["id"]: r["component"] for r in graph.connected_components(df, vertices).collect()}
    assert got == {name(i): name(root(i)) for i in range(210)}
    neighbours = {i: set() for i in range(210)}
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    for r in graph.clustering_coefficients(vertices, df).collect():
        around = neighbours[int(r["id"][1:])]
        t = sum(1 for x, y in itertools.combinations(around, 2) if y in neighbours[x])
        assert (r["degree"], r["triangles"]) == (len(around), t)


def test_path_graph_converges(spark):
    df = spark.range(300).select(
        F.format_string("%04d", "id").alias("src"), F.format_string("%04d", F.col("id") + 1).alias("dst")
    )
    got = graph.connected_components(df)
    assert got.count() == 301 and got.select("component").distinct().count() == 1


def test_temporal_and_cross_platform_equal_brute_force(spark):
    v = sample(n=90, copies=12)
    df = (
        frame(spark, v)
        .withColumnRenamed("content_id", "id")
        .withColumn("n", F.col("id").cast("int"))
        .withColumn("timestamp", F.timestamp_seconds(F.floor(F.col("n") / 7) * 3600 + F.col("n")))
        .withColumn("source_platform", F.concat(F.lit("p"), F.col("n") % 4))
    )
    df = cut_lineage(df)
    c = np.round(cosines(v), 12)
    for block_rows in (4096, 16):
        found, members = campaigns.temporal_patterns(df, threshold=0.8, block_rows=block_rows)
        expected = {}
        for h in range(13):
            ids = [i for i in range(90) if i // 7 == h]
            count = sum(c[i, j] >= 0.8 for i, j in itertools.combinations(ids, 2))
            if len(ids) >= 5 and count:
                expected[f"temporal_19700101_{h:02d}"] = (len(ids), count)
        got = {r["campaign_key"]: (r["campaign_size"], r["similar_pairs_count"]) for r in found.collect()}
        assert got == expected
        assert members.count() == sum(n for n, _ in expected.values())

        found, members = campaigns.cross_platform(df, threshold=0.9, block_rows=block_rows)
        expected = {}
        for a, b in itertools.combinations(range(4), 2):
            match = [(i, j) for i in range(90) for j in range(90) if i % 4 == a and j % 4 == b and c[i, j] >= 0.9]
            if len(match) >= 2:
                expected[f"cross_platform_p{a}_p{b}"] = (len(match), {str(x) for m in match for x in m})
        assert {r["campaign_key"]: r["matches"] for r in found.collect()} == {k: m for k, (m, _) in expected.items()}
        held = {}
        for r in members.collect():
            assert r["content_id"] not in held.setdefault(r["campaign_key"], set())
            held[r["campaign_key"]].add(r["content_id"])
        assert held == {k: ids for k, (_, ids) in expected.items()}


def test_search_equals_brute_force_over_query_blocks(spark):
    v = sample(n=50, copies=2)
    df = frame(spark, v).repartition(3)
    queries = df.where("cast(content_id as int) < 7").selectExpr("content_id as query_id", "embedding as query")
    c = np.round(cosines(v), 12)
    hits = {(r[0], r[1]) for r in pairs.find_similar(queries, df, 0.8, block=3).collect()}
    assert hits == {(str(q), str(i)) for q in range(7) for i in range(50) if c[q, i] >= 0.8}
    top = pairs.top_similar(queries, df, k=4, block=3).collect()
    for q in range(7):
        best = sorted(range(50), key=lambda i: (-c[q, i], str(i)))[:4]
        assert [r["content_id"] for r in sorted((r for r in top if r["query_id"] == str(q)), key=lambda r: r["rank"])] == [
            str(i) for i in best
        ]


def test_search_with_more_queries_than_one_pass(spark, monkeypatch):
    df = frame(spark, sample(n=60, copies=3))
    queries = df.selectExpr("content_id as query_id", "embedding as query")
    both = lambda: [sorted(map(tuple, f.collect())) for f in (pairs.find_similar(queries, df, 0.8), pairs.top_similar(queries, df, k=3))]
    whole = both()
    monkeypatch.setattr(pairs.config, "PASS_QUERIES", 7)
    assert both() == whole and len(whole[1]) == 180


def test_more_than_ten_thousand_queries(spark):
    many = spark.range(10_500).selectExpr("cast(id as string) as query_id", "array(1D, cast(id as double)) as query")
    one = spark.createDataFrame([("c", [1.0, 0.0])], "content_id string, embedding array<double>")
    assert pairs.find_similar(many, one, threshold=-1.0).count() == 10_500


def test_vectors_of_two_lengths_do_not_meet(spark):
    rows = [("a", [1.0, 0.0], "t"), ("b", [1.0, 0.1], "t"), ("c", [1.0, 0.0, 0.0], "t"), ("d", [1.0, 0.1, 0.0], "t")]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>, content_type string")
    got = {(r["content_id_1"], r["content_id_2"]) for r in pairs.sql_similar_pairs(df).collect()}
    assert got == {("a", "b"), ("c", "d")}


def test_search_treats_odd_vectors_as_dissimilar(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None)]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query array<double>")
    got = {r["content_id"]: r["similarity"] for r in pairs.top_similar(q, df, k=9).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}


def test_sql_cosine_edge_cases(spark):
    vx.register_cosine_similarity(spark)
    row = spark.sql(
        "select cosine_similarity(array(1D), array(1D, 2D)) a, cosine_similarity(array(0D), array(1D)) b, "
        "cosine_similarity(array(3D, 4D), array(3D, 4D)) c"
    ).first()
    assert row["a"] is None and row["b"] == 0.0 and row["c"] == pytest.approx(1.0)


def brute_overlap(texts, ratio):
    sets = {i: set(t.lower().split(" ")) for i, t in texts.items()}
    return {
        (a, b): len(sets[a] & sets[b]) / len(sets[a])
        for a in sets
        for b in sets
        if a < b and len(sets[a] & sets[b]) / len(sets[a]) > ratio
    }


@pytest.mark.parametrize("ratio", [0.5, 0.8])
def test_word_overlap_equals_brute_force(spark, ratio):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(40)]
    odds = 1 / np.arange(1, 41)
    texts = {
        str(i): " ".join(rng.choice(vocabulary, size=int(rng.integers(6, 14)), p=odds / odds.sum())) for i in range(70)
    }
    for i in range(40, 60):
        texts[str(i)] = texts["3"]  # a group of copies
    for i in range(61, 69, 2):
        texts[str(i)] = texts["5"]  # another one, with ids in between
    df = spark.createDataFrame([(i, t, len(t.split())) for i, t in texts.items()], "id string, content string, word_count int")
    expected = brute_overlap(texts, ratio)
    every = overlap.word_overlap_pairs(df, min_ratio=ratio, limit=None).collect()
    assert {(r[0], r[1]): r[2] for r in every} == pytest.approx(expected)
    assert len(every) == len(expected)
    counts = {r["word_overlap_ratio"]: r["n"] for r in overlap.word_overlap_counts(df, min_ratio=ratio).collect() if r["n"]}
    assert counts == {x: list(expected.values()).count(x) for x in expected.values()}
    for k in (5, 20, 200):
        top = overlap.word_overlap_pairs(df, min_ratio=ratio, limit=k).collect()
        best = sorted(expected, key=lambda p: (-expected[p], p))[:k]
        assert [(r[0], r[1]) for r in top] == best


def test_split_posting_lists_give_the_same_pairs(spark):
    rows = [(str(i), f"common words are shared by all x{i % 9} y{i % 4}", 8) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, content string, word_count int")
    _, sets = overlap.distinct_token_sets(df, "id", "content")
    ordered = overlap.ordered_sets(sets)
    one = {tuple(r) for r in overlap.overlap_set_pairs(sets, ordered).collect()}
    assert {tuple(r) for r in overlap.overlap_set_pairs(sets, ordered, posting=3).collect()} == one


def test_word_overlap_descends_only_as_far_as_needed(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = {f"{i:02}": " ".join(f"w{x}" for x in rng.choice(300, 30, replace=False)) for i in range(40)}
    texts |= {f"c{i}": texts["07"] for i in range(3)} | {f"d{i}": texts["08"] + f" extra{i}" for i in range(3)}
    df = spark.createDataFrame([(i, t, 30) for i, t in texts.items()], "id string, content string, word_count int")
    asked = []
    plain = overlap.overlap_set_pairs

    def seen(sets, ordered, ratio, *more):
        asked.append(ratio)
        return plain(sets, ordered, ratio, *more)

    monkeypatch.setattr(overlap, "overlap_set_pairs", seen)
    expected = brute_overlap(texts, 0.5)
    for k, ratios in ((2, [0.95]), (500, [0.95, 0.8, 0.5])):
        asked.clear()
        top = overlap.word_overlap_pairs(df, limit=k).collect()
        assert [(r[0], r[1]) for r in top] == sorted(expected, key=lambda p: (-expected[p], p))[:k]
        assert asked == ratios


def test_star_edges_connect_like_union_find(spark):
    v = sample(n=80, copies=1)
    df = frame(spark, v)
    reps = cut_lineage(blocks.representatives(blocks.unit_members(df, "content_id", "embedding")).selectExpr("*", "null as platform"))
    placed = cut_lineage(blocks.place(reps, 0.9, block_rows=8))
    # with one sample needed, every row is a core row
    passed = blocks.blocked_join(placed, blocks.cluster_kernel(1), blocks.CLUSTER_SCHEMA, 0.9, carry=["platform"])
    stars = passed.where("kind = 'star'").selectExpr("rep as src", "other as dst")
    assert placed.select("own").distinct().count() > 5 and passed.where("kind = 'edge'").count() == 0
    got = {r["id"]: r["component"] for r in graph.connected_components(stars, reps.selectExpr("rep as id")).collect()}
    found = pairs.similar_pairs(df, threshold=0.9).selectExpr("content_id_1 as src", "content_id_2 as dst")
    assert got == {r["id"]: r["component"] for r in graph.connected_components(found, reps.selectExpr("rep as id")).collect()}


def test_rows_are_not_copied_for_each_block_they_meet(spark):
    v = sample(n=80, copies=1)
    df = frame(spark, v)
    reps = cut_lineage(blocks.representatives(blocks.unit_members(df, "content_id", "embedding")))
    n = reps.count()
    for rows in (8, 64):
        placed = cut_lineage(blocks.place(reps, 0.2, block_rows=rows))
        found = blocks.blocked_join(placed, blocks.pair_kernel, blocks.PAIR_SCHEMA, 0.2)
        plan = found._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "explode(partners" not in plan
        u = np.stack([r["vec"] for r in reps.collect()])
        assert found.count() == int(np.triu(np.round(u @ u.T, 12) >= 0.2, 1).sum()) and len(u) == n


def test_triangles_of_many_groups(spark, monkeypatch):
    """Lists in groups of a few edges, read in small pieces: weighted triangles as counted one by one."""
    monkeypatch.setattr(graph, "_GROUP_EDGES", 60)
    monkeypatch.setattr(graph, "_ENTRIES", 16)
    rng = np.random.default_rng(4)
    linked = np.triu(rng.random((30, 30)) < 0.4, 1)
    linked |= linked.T
    copies = rng.integers(1, 4, 30)
    owner = np.repeat(np.arange(30), copies)
    ids = linked[np.ix_(owner, owner)] | (owner[:, None] == owner[None, :])
    np.fill_diagonal(ids, False)
    around = np.diag(np.linalg.matrix_power(ids.astype("int64"), 3)) // 2
    vertices = spark.createDataFrame([(f"v{k:02}", int(c)) for k, c in enumerate(copies)], "id string, copies long")
    edges = spark.createDataFrame([(f"v{i:02}", f"v{j:02}") for i, j in zip(*np.nonzero(np.triu(linked)))], "src string, dst string")
    got = {r["id"]: (r["degree"], r["triangles"]) for r in graph.clustering_coefficients(vertices, edges).collect()}
    first = np.cumsum(copies) - copies
    assert got == {f"v{k:02}": (int(ids[first[k]].sum()), int(around[first[k]])) for k in range(30)}


def two_models(n=40, seed=3):
    """Vectors of two lengths, the second ones in tight groups as well."""
    rng = np.random.default_rng(seed)
    out = {}
    for k, length in enumerate((4, 6)):
        centres = rng.normal(size=(4, length))
        for i in range(n):
            v = centres[i % 4] + rng.normal(scale=0.05, size=length)
            out[f"m{k}_{i:02}"] = v.tolist()
    return out


def test_vectors_of_two_models(spark):
    """Clusters, hours, platforms and buckets of a table with two embedding lengths: each length as if it were alone."""
    v = two_models()
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, x, f"p{k % 3}", start + datetime.timedelta(minutes=7 * (k % 20))) for k, (i, x) in enumerate(v.items())]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, source_platform string, timestamp timestamp")
    parts = [df.where(F.size("embedding") == n) for n in (4, 6)]

    def both(run):
        whole = run(df)
        return sorted(whole), sorted(x for p in parts for x in run(p))

    members = lambda d: [tuple(r) for r in clusters.semantic_clusters(d, id="id", block_rows=8)[0].collect()]
    got, alone = both(members)
    assert got == alone and len(got) == len(v)
    lsh = lambda d: [tuple(r)[:2] for r in pairs.lsh_pairs(d, id="id", threshold=0.9, block_rows=8).collect()]
    got, alone = both(lsh)
    assert got == alone and got
    matches = lambda d: [(r["platform_1"], r["platform_2"], r["matches"]) for r in campaigns.cross_platform(d, block_rows=8)[0].collect()]
    totals = [dict(((a, b), n) for a, b, n in matches(p)) for p in parts]
    assert {(a, b): n for a, b, n in matches(df)} == {k: sum(t.get(k, 0) for t in totals) for k in {k for t in totals for k in t}}
    hours = lambda d: [(r["hour"], r["similar_pairs_count"]) for r in campaigns.temporal_patterns(d, min_size=1, block_rows=8)[0].collect()]
    totals = [dict(hours(p)) for p in parts]
    assert dict(hours(df)) == {k: sum(t.get(k, 0) for t in totals) for k in {k for t in totals for k in t}}


def test_tiles_and_cells_skip_pairs(spark):
    """Groups of directions that are apart: what a block pair compares falls far below all pairs, and no pair is lost."""
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    v = np.repeat(centres, 200, axis=0) + rng.normal(scale=0.05, size=(2400, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"r{i:04}", x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>")
    reps = cut_lineage(blocks.representatives(blocks.unit_members(df, "content_id", "embedding")))
    placed = blocks.place(reps, 0.9, block_rows=256)
    met = placed.select(F.size("partners").alias("n")).agg(F.avg("n")).first()[0]
    assert met < 0.4 * placed.select("own").distinct().count()
    sims = v @ v.T
    want = int((np.triu(np.round(sims, 12) >= 0.9, 1)).sum())
    assert pairs.similar_pairs(df, threshold=0.9).count() == want
    compared = sum(len(li) * len(ri) for li, ri in blocks_compared(v, 0.9))
    assert compared < 0.7 * len(v) ** 2 / 2


def blocks_compared(v, threshold):
    """Row sets that tiles of one block compare, with coordinates as the join takes them."""
    at = v @ np.linalg.svd(v - v.mean(axis=0), full_matrices=False)[2][:8].T
    parts, low, high = blocks._tiles(np.arange(len(v)), at)
    near = blocks._gaps(low, high, low, high) <= blocks._reach(threshold)
    return [(parts[a], parts[b]) for a in range(len(parts)) for b in range(a, len(parts)) if near[a, b]]


def copied(seed=8):
    """Vectors of which several occur more than once, two without use."""
    rng = np.random.default_rng(seed)
    v = sample(n=60, copies=9, seed=seed)
    v[20:24] = v[20]
    v[40:42] = v[40]
    return v


def test_factorised_figures_equal_those_of_listed_pairs(spark):
    v = copied()
    df = frame(spark, v)
    df = df.unionByName(spark.createDataFrame([("z1", None), ("z2", [0.0] * 8)], df.schema))
    listed = cut_lineage(pairs.similar_pairs(df, threshold=0.9))
    members, near = pairs.similar_groups(df, threshold=0.9)
    members, near = cut_lineage(members), cut_lineage(near)
    assert near.count() < listed.count()
    # groups of equal similarity
    groups, ids = pairs.equal_similarity_groups(members, near, digits=2)
    got = {(r["similarity"], r["content_id"], r["campaign_size"], round(r["avg_similarity"], 9)) for r in ids.join(groups, "similarity").collect()}
    plain = pairs.equal_similarity_campaigns(listed, digits=2)
    assert got == {(r["similarity"], r["content_id"], r["campaign_size"], round(r["avg_similarity"], 9)) for r in plain.collect()} and got
    # ids of any pair
    assert {r[0] for r in pairs.similar_ids(df, threshold=0.9, block_rows=16).collect()} == {r[0] for r in pairs.suspicious_ids(listed).collect()}
    # graph
    ids = df.select(F.col("content_id").alias("id"))
    one, edges = graph.similarity_graph(listed, ids)
    vertices, links, named = graph.factorised_graph(ids, members, near)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(graph.of_ids(graph.clustering_coefficients(vertices, links), named).select("id", "degree", "triangles", "coefficient")) == rows(graph.clustering_coefficients(one, edges))
    assert rows(graph.of_ids(graph.connected_components(links, vertices), named).select("id", "component")) == rows(graph.connected_components(edges.select("src", "dst"), one))
    for a, b in zip(graph.analyze_network(vertices, links, 3, named), graph.analyze_network(one, edges, 3)):
        x, y = (a.orderBy(a.columns[:1]).toPandas(), b.select(a.columns).orderBy(a.columns[:1]).toPandas())
        for c in a.columns:
            assert x[c].tolist() == (pytest.approx(y[c].tolist()) if x[c].dtype.kind == "f" else y[c].tolist())


def test_core_rows_of_a_block_are_reported_once(spark):
    rng = np.random.default_rng(5)
    v = np.ones((240, 12)) + rng.normal(scale=0.05, size=(240, 12))
    v[200:, :6] *= -1  # two dense groups
    df = frame(spark, v)
    members = blocks.unit_members(df, "content_id", "embedding")
    reps = cut_lineage(blocks.representatives(members).selectExpr("*", "null as platform"))
    placed = cut_lineage(blocks.place(reps, 0.9, block_rows=16))
    parts = placed.select("own").distinct().count()
    rows = cut_lineage(clusters.pass_over(reps, 0.9, 3, 16))
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert parts > 10
    assert kinds["degree"] == 240  # not once for every block that a row meets
    assert 238 <= kinds["star"] < 240 + parts * parts / 2 and kinds.get("edge", 0) == 0
    found = clusters.semantic_clusters(df, threshold=0.9, block_rows=16)[1]
    assert {(r["cluster"], r["cluster_size"]) for r in found.collect()} == {("0", 200), ("200", 40)}


def test_partitions_send_forests_instead_of_edges(spark, monkeypatch):
    edges = [(f"{g}-{a:02d}", f"{g}-{b:02d}") for g in "xyz" for a in range(40) for b in range(a)]
    df = spark.createDataFrame(edges + [("y-03", "z-07"), ("q", "q"), (None, "x-01")], "src string, dst string").repartition(3)
    sent = df.where("src <> dst").mapInArrow(graph._forest, df.schema)
    assert df.count() > 2000 and sent.count() <= 3 * 120  # at most one edge a vertex and partition
    ids = spark.createDataFrame([(f"{g}-{a:02d}",) for g in "xyz" for a in range(40)] + [("q",)], "id string")
    got = {r["id"]: r["component"] for r in graph.connected_components(df, ids).collect()}
    assert got == {i: {"x": "x-00", "y": "y-00", "z": "y-00", "q": "q"}[i[0]] for i in got} and len(got) == 121
    # a partition of more vertices than a task holds sends several forests
    table = df.where("src <> dst").toArrow()
    monkeypatch.setattr(graph, "_FOREST_EDGES", 50)
    parts = list(graph._forest(table.to_batches(max_chunksize=20)))
    assert len(parts) > 1 and graph._spanning(table).num_rows == 118
    assert sorted(graph._spanning(graph.pa.Table.from_batches(parts)).column("dst").to_pylist()) and sum(p.num_rows for p in parts) < 2341


def test_pairs_are_listed_where_they_are_compared(spark, monkeypatch):
    """Ids travel with the vectors: no pair is joined to its ids afterwards."""
    monkeypatch.setattr(pairs, "expand_pairs", None)
    monkeypatch.setattr(blocks, "_LIST_ROWS", 50)  # many portions
    v = copied()
    rows = [(str(i), [float(x) for x in row], "xy"[i % 2]) for i, row in enumerate(v)] + [("7", [float(x) for x in v[7]], "x"), (None, [float(x) for x in v[7]], "x")]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>, platform string")
    got = sorted((r["content_id_1"], r["content_id_2"], r["platform_1"], r["platform_2"]) for r in pairs.similar_pairs(df, threshold=0.9, block_rows=16, keep=["platform"]).collect())
    c = np.round(cosines(np.array([r[1] for r in rows[:-1]])), 12)
    want = [sorted((rows[i], rows[j]), key=lambda r: r[0]) for i, j in itertools.combinations(range(len(rows) - 1), 2) if c[i, j] >= 0.9]
    assert got == sorted((a[0], b[0], a[2], b[2]) for a, b in want if a[0] != b[0])
    matches = campaigns.cross_platform_matches(pairs.similar_pairs(df, threshold=0.9, keep=["platform"]))
    assert {(r["platform_1"], r["platform_2"]) for r in matches.collect()} == {("x", "y")}


def test_chunks_of_copies_meet_each_other(spark):
    df = frame(spark, np.array([[1.0, 0.0]] * 25 + [[1.0, 0.01]] * 3 + [[0.0, 1.0]]))
    members = blocks.unit_members(df, "content_id", "embedding")
    chunks = blocks.id_chunks(members, chunk=4).collect()
    assert len(chunks) > 5 and sum(len(r["ids"]) for r in chunks) == sum(r["copies"] for r in chunks) == 29
    placed = blocks.place(cut_lineage(blocks.id_chunks(members, chunk=4)), 0.9, block_rows=4)
    listed = blocks.blocked_join(placed, blocks.list_kernel(), blocks.list_schema(), 0.9, carry=["ids"]).collect()
    assert len(listed) == 28 * 27 / 2 == len({(r[0], r[1]) for r in listed})


def test_weighed_pairs_are_not_stored(spark, monkeypatch):
    """Only ends per value are written for groups of equal similarity."""
    stored = []
    monkeypatch.setattr(pairs, "cut_lineage", lambda d: stored.append(d.columns) or cut_lineage(d))
    members, near = (cut_lineage(d) for d in pairs.similar_groups(frame(spark, copied()), threshold=0.9))
    stored.clear()
    pairs.equal_similarity_groups(members, near, digits=2)
    assert stored and all("ends" not in columns for columns in stored)


def test_hashing_embedding_counts_words_in_batches(spark):
    """No array is built element by element (F31, F33, F37); the vectors are those of plain Python."""
    import hashlib

    texts = ["", "  ", None, "a A b", "Über \t den  ŒX \U0001f600", "w " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    found = vx.hashing_embedding(df, dim=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    for r in found.collect():
        if r["content"] is None:
            assert r["embedding"] is None
            continue
        want = [0.0] * 16
        for w in r["content"].lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        size = sum(x * x for x in want) ** 0.5
        assert r["embedding"] == [x / size if size else 0.0 for x in want]


def test_vectors_come_back_bit_by_bit(spark):
    rng = np.random.default_rng(5)
    rows = [[0.0, -0.0, 1.0, float("nan")], [], rng.normal(size=300).tolist(), (rng.integers(0, 3, 384) / 7).tolist()]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, vec array<double>")
    kept = {r.n: np.array(r.vec, dtype="float64").tobytes() for r in blocks.full(blocks.slim(df)).collect()}
    assert kept == {n: np.array(v, dtype="float64").tobytes() for n, v in enumerate(rows)}


@pytest.mark.parametrize("operator", ["groups", "clusters"])
def test_intermediate_vectors_take_little_space(spark, operator):
    """Word counts: all that is stored on the way is smaller than the plain vectors, though they are stored several times."""
    rng = np.random.default_rng(6)
    rows = [(f"{i:04d}", rng.poisson(0.4, 384).astype(float).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "content_id string, embedding array<double>")
    folder = workspace(spark).removeprefix("file:")

    def stored():
        return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names)

    before = stored()
    if operator == "groups":
        pairs.similar_groups(df, threshold=0.9)
    else:
        clusters.semantic_clusters(df, threshold=0.9)
    assert stored() - before < 1500 * 384 * 8 * 0.4


def test_top_overlap_is_settled_by_the_smallest_ids(spark, monkeypatch):
    """Texts that hold all words of the first ones end the search before any words are probed; with too few of them it goes on."""
    rng = np.random.default_rng(12)
    texts = {f"{i:03}": " ".join(f"w{x}" for x in rng.choice(400, 25, replace=False)) for i in range(80)}
    texts |= {f"9{i}": texts[f"{i:03}"] + f" more{i}" for i in range(4)} | {f"8{i}": texts["002"] for i in range(3)}
    rows = [(i, t, 25) for i, t in texts.items()] + [(None, texts["000"], 25)]
    df = spark.createDataFrame(rows, "id string, content string, word_count int")
    asked = []
    plain = overlap.overlap_set_pairs
    monkeypatch.setattr(overlap, "overlap_set_pairs", lambda sets, ordered, ratio, *more: asked.append(ratio) or plain(sets, ordered, ratio, *more))
    expected = brute_overlap(texts, 0.5)
    for k, head, ratios in ((5, 8, []), (5, 1, [0.95])):
        asked.clear()
        top = overlap.word_overlap_pairs(df, limit=k, head=head).collect()
        assert [(r[0], r[1]) for r in top] == sorted(expected, key=lambda p: (-expected[p], p))[:k]
        assert asked == ratios


@pytest.mark.parametrize("block_rows,ratio", [(7, 0.5), (1000, 0.3)])
def test_overlap_counts_join_no_candidates(spark, monkeypatch, block_rows, ratio):
    """Overlap is counted block by block inside the tasks; no candidate pair is joined or shuffled (F1)."""
    rng = np.random.default_rng(3)
    tongues = [[f"{t}{i}" for i in range(60)] for t in "ab"]
    texts = {f"{i:03}": " ".join(rng.choice(tongues[i % 2], size=int(rng.integers(6, 40)))) for i in range(60)}
    texts |= {f"{i:03}x": texts["010"] for i in range(0, 60, 4)} | {f"{i:03}y": texts["013"] for i in range(1, 60, 9)}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()] + [(None, texts["003"], 9)], "id string, content string, word_count int")
    monkeypatch.setattr(overlap, "overlap_set_pairs", lambda *_: pytest.fail("candidates are joined"))
    expected = brute_overlap(texts, ratio)
    counts = overlap.word_overlap_counts(df, min_ratio=ratio, chunk=4, block_rows=block_rows).collect()
    assert {r["word_overlap_ratio"]: r["n"] for r in counts if r["n"]} == {x: list(expected.values()).count(x) for x in expected.values()}


def _held_block(own, vectors, names, platform, fold=None):
    """A block as tasks unpack it; its first two coordinates and the length of the rest bound its tiles."""
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = np.column_stack([vectors[:, :2], np.linalg.norm(vectors[:, 2:], axis=1)])
    n = len(vectors)
    table = blocks.pa.table({
        "rep": names, "copies": np.ones(n, dtype="int64"), "platform": platform, "own": np.full(n, own),
        "vec": blocks.pa.array(list(vectors), blocks.pa.list_(blocks.pa.float64())), "at": blocks.pa.array(list(at), blocks.pa.list_(blocks.pa.float64())),
    })
    table = blocks._tiled(table) if fold is None else fold.prepared(blocks._tiled(table), 0.85, False)
    return blocks._Block(own, vectors.shape[1], at.min(axis=0), at.max(axis=0), table)


def test_single_precision_decides_as_double_precision_does():
    """Pairs within the error bound of single precision, right at the threshold among them, are compared in doubles."""
    rng = np.random.default_rng(5)
    base = np.eye(16)[:1]
    away = rng.normal(size=(150, 15))
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosines = 0.85 + rng.choice([0, 1e-13, -1e-13, 1e-11, -1e-11, 1e-7, -1e-7, 0.05, -0.05], size=150)
    ring = np.column_stack([cosines, np.sqrt(1 - cosines**2)[:, None] * away])
    one = _held_block(0, np.vstack([base, ring]), [f"a{i}" for i in range(151)], ["p"] * 151)
    two = _held_block(1, np.vstack([base, ring[::-1]]), [f"b{i}" for i in range(151)], ["q"] * 151)
    for left, right in ((one, two), (one, one)):
        for strict in (False, True):
            exact = {(int(i), int(j)) for a, b, _ in blocks._scored(left, right, 0.85, strict) for i, j in zip(a, b)}
            behind, found = 0 if left is right else left.rows, set()
            for t, begin, end in blocks._tile_runs(left, right, blocks._reach(0.85)):
                i, j = np.nonzero(blocks._near(left, right, 0.85, strict, t, begin, end))
                found |= {(int(left.starts[t] + x), int(behind + begin + y)) for x, y in zip(i, j)}
            assert found == exact and exact


def test_tiles_of_one_part_are_not_compared_again(monkeypatch):
    """Rows that are core rows of one part have nothing left to find for clusters; the parts are still connected."""
    rng = np.random.default_rng(6)
    fold = blocks.cluster_kernel(3)
    dense = [np.eye(12)[0] + 0.05 * rng.normal(size=(700, 12)) for _ in range(2)]
    held = [_held_block(k, v, [f"{k}-{i}" for i in range(700)], [None] * 700, fold) for k, v in enumerate(dense)]
    assert all((b.table.column("root").to_numpy() == 0).all() for b in held)
    plain, calls = blocks._near, []
    monkeypatch.setattr(blocks, "_near", lambda *x: calls.append(x) or plain(*x))
    task = fold.begun(held, 0.85, False)
    for one, two in ((held[0], held[0]), (held[0], held[1]), (held[1], held[1])):
        task.add(one, two)
    assert len(calls) == 1  # of more than sixty pairs of tiles, in one run
    assert (task.root == 0).all() and not len(task.open[0])


@pytest.mark.parametrize("kinds", [3, 70])
def test_platform_counts_equal_brute_force_for_any_number_of_platforms(kinds):
    rng = np.random.default_rng(7)
    vectors = [rng.normal(size=(160, 3)) for _ in range(2)]
    platforms = [[None if x == kinds else f"p{x}" for x in rng.integers(0, kinds + 1, 160)] for _ in range(2)]
    held = [_held_block(k, v, [f"{k}-{i}" for i in range(160)], p) for k, (v, p) in enumerate(zip(vectors, platforms))]
    task = blocks.platform_kernel().begun(held, 0.85, False)
    for one, two in ((held[0], held[0]), (held[0], held[1]), (held[1], held[1])):
        task.add(one, two)
    schema = blocks.pa.schema([("rep", "string"), ("platform", "string"), ("other", "string"), ("matches", "int64")])
    found = {(r["rep"], r["platform"], r["other"]): r["matches"] for t in task.rows(schema) for r in t.to_pylist()}
    every, of = np.vstack(vectors), sum(platforms, [])
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    expected = {}
    for i, j in zip(*np.nonzero(np.round(every @ every.T, 12) >= 0.85)):
        if of[i] is not None and of[j] is not None and of[i] != of[j]:
            key = (f"{i // 160}-{i % 160}", of[i], of[j])
            expected[key] = expected.get(key, 0) + 1
    assert found == expected and found


def test_pairs_leave_a_task_in_portions(monkeypatch):
    """The pairs of two blocks are handed on part by part, the smaller id first (F2)."""
    rng = np.random.default_rng(8)
    one, two = (_held_block(k, rng.normal(size=(200, 3)), [f"{x}" for x in rng.permutation(1000)[:200] + 1000 * k], ["p"] * 200) for k in range(2))
    monkeypatch.setattr(blocks, "_LIST_ROWS", 500)
    table = blocks.pa.concat_tables([one.table, two.table])
    parts = list(blocks.pair_kernel(table, blocks._scored(one, two, 0.85, False)))
    assert len(parts) > 1
    pairs_found = [(a, b) for p in parts for a, b in zip(p["rep_1"].to_pylist(), p["rep_2"].to_pylist())]
    near = np.round(one.vec @ two.vec.T, 12) >= 0.85
    names = [b.table.column("rep").to_pylist() for b in (one, two)]
    assert sorted(pairs_found) == sorted(tuple(sorted((names[0][i], names[1][j]))) for i, j in zip(*np.nonzero(near)))


def test_neighbour_lists_are_packed_before_they_are_shuffled():
    """A partition sends one compressed row a group, not a row per edge; an edge that comes twice is one."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 3000, (2, 60_000))
    table = graph.pa.table({"a": a, "ca": np.ones(60_000, dtype="int64"), "b": b, "cb": np.ones(60_000, dtype="int64")})
    sent = list(graph._chunks(4)(table.to_batches(max_chunksize=7000)))
    assert len(sent) == 4 and sum(x.nbytes for x in sent) < 6 * 60_000
    found = set()
    for x in sent:
        packed = graph._pack_lists(graph.pa.Table.from_batches([x, x]))  # as if two partitions held the same edges
        keys, starts, _, near, _ = graph._lists(packed.column("data")[0])
        edges = list(zip(np.repeat(keys, np.diff(starts)).tolist(), near.tolist()))
        assert len(edges) == len(set(edges))
        found |= set(edges)
    assert found == set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("broadcast", [0, 1 << 21])
def test_coefficients_of_weighted_vertices_equal_brute_force(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(10)
    n, copies = 24, [int(x) for x in rng.integers(1, 4, 24)]
    linked = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3]
    of = np.repeat(np.arange(n), copies)
    near = np.array([[x != y and (p == q or (min(p, q), max(p, q)) in linked) for y, q in enumerate(of)] for x, p in enumerate(of)]).astype(int)
    degree, triangles = near.sum(axis=1), np.diag(near @ near @ near) // 2
    monkeypatch.setattr(graph, "_VERTICES", broadcast)
    edges = spark.createDataFrame([(f"v{i}", f"v{j}") for i, j in linked + linked[:9]], "src string, dst string")  # some come twice
    vertices = spark.createDataFrame([(f"v{i}", c) for i, c in enumerate(copies)], "id string, copies long")
    found = {r["id"]: (r["degree"], r["triangles"]) for r in graph.clustering_coefficients(vertices, edges).collect()}
    first = {f"v{v}": int(np.flatnonzero(of == v)[0]) for v in range(n)}
    assert found == {v: (degree[x], triangles[x]) for v, x in first.items()}


@pytest.mark.parametrize("threshold,block_rows", [(0.4, 40), (0.9, 1000)])
def test_lsh_compares_what_shares_a_bucket_without_a_row_per_table(spark, monkeypatch, threshold, block_rows):
    """Every vector is placed once, whatever the number of tables; the pairs are those that share a bucket."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(30, 8))[rng.integers(0, 30, 120)] + 0.3 * rng.normal(size=(120, 8))
    v[40:44] = v[3]
    plain, placed = blocks.blocked_join, []
    monkeypatch.setattr(blocks, "blocked_join", lambda rows, *x, **y: placed.append(rows.count()) or plain(rows, *x, **y))
    ids = [f"{i:03}" for i in range(120)]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in zip(ids, v)], "content_id string, embedding array<double>")
    found = sorted((r[0], r[1]) for r in pairs.lsh_pairs(df, threshold=threshold, recall=0.6, block_rows=block_rows).collect())
    assert placed == [116]
    tables = max(1, int(np.ceil(np.log(0.4) / np.log1p(-((1 - np.arccos(threshold) / np.pi) ** 8)))))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    signs = (unit @ np.random.default_rng([1, 8]).normal(size=(8, tables * 8)) > 0).reshape(120, tables, 8)
    shared = (signs[:, None] == signs[None]).all(axis=3).any(axis=2)
    near = np.round(unit @ unit.T, 12) >= threshold
    assert found == [(ids[i], ids[j]) for i in range(120) for j in range(i + 1, 120) if shared[i, j] and near[i, j]]
    assert (shared & near).sum() < near.sum() or threshold > 0.5
