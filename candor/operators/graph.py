"""Connected components, density and clustering coefficient of a similarity graph."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor import config
from candor.operators.blocks import _joined
from candor.operators.skew import balanced_join, lookup
from candor.session import cut_lineage, written

_GROUP_EDGES = 2_000_000  # edges whose lists one task holds of either side
_FOREST_EDGES = 1 << 21  # edges that a task connects at once
_ENTRIES = 1 << 20  # list entries compared at once
_VERTICES = 1 << 21  # vertices, as rows of an id and numbers, that are broadcast to the edges
_COUNTS = 1 << 21  # counts a task holds before it adds them up


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
                F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
            )
        ).alias("e")
    ).select("e.u", "e.v")


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """Connect the listed neighbours v of u to the smallest id around u."""
    small = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(
        "u", F.least("u", "m").alias("m"), "n"
    )
    return lookup(pairs, small, ["u"], "n", total=total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    linked = _star(_both_ways(edges), 2 * total).where("v > u and v <> m")
    return linked.select(F.col("m").alias("src"), F.col("v").alias("dst")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    hub = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _star(down, total).where("v <> m").select(F.col("m").alias("src"), F.col("v").alias("dst"))
    kept = hub.select(F.col("m").alias("src"), F.col("u").alias("dst"))
    return moved.unionByName(kept).distinct()


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()


def _spanning(table: pa.Table) -> pa.Table:
    """Few edges (first vertex of a part, other vertex) that connect what the edges (src, dst) of ``table`` connect."""
    ends = pa.chunked_array(table.column("src").chunks + table.column("dst").chunks, table.schema.field("src").type)
    ends = ends.combine_chunks().dictionary_encode()
    codes, ids = ends.indices.to_numpy(zero_copy_only=False), ends.dictionary
    root = _joined(np.arange(len(ids)), codes[: table.num_rows], codes[table.num_rows :])
    away = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table([ids.take(pa.array(root[away])), ids.take(pa.array(away))], schema=table.schema)


def _forest(batches):
    """The edges of a partition as spanning forests: at most one edge a vertex, as long as the forest fits ``_FOREST_EDGES`` half."""
    held, rows = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= _FOREST_EDGES:
            found = _spanning(pa.concat_tables(held))
            held, rows = [found], found.num_rows
            if rows > _FOREST_EDGES // 2:
                yield from found.to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
    if held:
        yield from _spanning(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id of the connected part.

    Alternating large-star and small-star until nothing moves; every round is
    checkpointed, so neither the plan nor a lost executor replays earlier rounds. Each partition first reduces its edges to
    a forest, so what is shuffled follows the vertices of the partitions and not their edges.
    ``vertices`` (column ``id``) adds the isolated ones.
    """
    start = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    forest = start.where("src <> dst").mapInArrow(_forest, start.schema)
    now = cut_lineage(forest.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now, seen[0]), 2 * seen[0]))
        mark = _fingerprint(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not converge")
    linked = now.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    roots = now.select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
    found = linked.unionByName(roots)
    if vertices is None:
        return found
    return vertices.select("id").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def similarity_graph(pairs: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with cosine weights; isolated vertices are kept."""
    edges = pairs.select(
        F.col("content_id_1").alias("src"), F.col("content_id_2").alias("dst"), F.col("similarity_score").alias("weight")
    )
    return vertices.select(F.col("id").cast("string").alias("id")), edges


def factorised_graph(ids: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, named) of a similarity graph whose copies are one weighted vertex each.

    ``members`` and ``pairs`` come from ``pairs.similar_groups``; ``ids`` (column ``id``) has every id once, also those without a
    usable vector. A vertex of n copies stands for n ids that are all linked with each other and have the same neighbours.
    ``named`` maps every id to its vertex (columns id, rep, copies).
    """
    grouped = members.select("id", "rep", "copies")
    alone = ids.select(F.col("id").cast("string").alias("id")).join(grouped.select("id"), "id", "left_anti")
    named = written(grouped.unionByName(alone.select("id", F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"))), "named")
    vertices = cut_lineage(named.where("id = rep").select("id", "copies"))
    return vertices, written(pairs.select(F.col("rep_1").alias("src"), F.col("rep_2").alias("dst")), "edges"), named


def of_ids(found: DataFrame, named: DataFrame) -> DataFrame:
    """Rows per vertex (column ``id``) -> rows per id; the vertices of many copies are broadcast."""
    table = found.withColumnRenamed("id", "rep").join(named.where("id = rep").select("rep", F.col("copies").alias("_weight")), "rep")
    rows = lookup(named.select("id", "rep"), table, ["rep"], "_weight")
    return rows.drop("rep")


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _single(table: pa.Table) -> pa.Table:
    """The directed edges ordered by (a, b), each once."""
    kept = table.select(["a", "ca", "b", "cb"]).sort_by([("a", "ascending"), ("b", "ascending")]).combine_chunks()
    a, b = kept.column("a").to_numpy(), kept.column("b").to_numpy()
    other = np.ones(len(a), dtype=bool)
    other[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
    return kept if other.all() else kept.filter(pa.array(other))


_PACKED = "part int, data binary"


def _chunks(groups: int):
    """Packs the directed edges of a partition by the group of their first vertex, so what is shuffled is compressed."""

    def packed(held):
        table = pa.concat_tables(held)
        # places of the vertices in no order: neighbours in number share no group
        part = ((table.column("a").to_numpy().astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
        for x in np.unique(part):
            data = _stream(_single(table.filter(pa.array(part == x))))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= _FOREST_EDGES:
                yield from packed(held)
                held, rows = [], 0
        if held:
            yield from packed(held)

    return run


def _pack_lists(table: pa.Table) -> pa.Table:
    """The chunks of one group as one row, its edges ordered by (a, b)."""
    parts = [pa.ipc.open_stream(d.as_buffer()).read_all() for d in table.column("data")]
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "data": pa.array([_stream(_single(pa.concat_tables(parts)))], pa.binary())})


def _lists(data) -> tuple:
    """(vertices, list starts, copies of a vertex, neighbours, their copies) of a packed group."""
    a, ca, b, cb = (c.to_numpy() for c in pa.ipc.open_stream(data.as_buffer()).read_all().columns)
    starts = np.flatnonzero(np.diff(a, prepend=a[0] - 1))
    return a[starts], np.append(starts, len(a)), ca[starts], b, cb


def _closed(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the triangles a, b, x with a of the first group and b of the second one, for each of their vertices."""
    keys, starts, ca, b, cb = first
    keys_2, starts_2, _, x, cx = second
    at = np.minimum(np.searchsorted(keys_2, b), len(keys_2) - 1)
    linked = np.flatnonzero(keys_2[at] == b)  # edges whose far end has its list here
    names, spot = np.unique(x, return_inverse=True)
    of_a, of_b, of_x = (np.zeros(len(k), dtype="int64") for k in (keys, keys_2, names))
    sizes = np.diff(starts_2)[at[linked]]
    owner = np.searchsorted(starts, linked, side="right") - 1
    # edges of one vertex, in pieces that read a bounded number of list entries
    piece = (np.cumsum(sizes) - sizes) // _ENTRIES
    cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(piece) != 0)) + 1
    for edges in np.split(np.arange(len(linked)), cuts) if len(linked) else ():
        v, rows, n = owner[edges[0]], at[linked[edges]], sizes[edges]
        entries = np.repeat(starts_2[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = b[starts[v] : starts[v + 1]]
        hit = near[np.minimum(np.searchsorted(near, x[entries]), len(near) - 1)] == x[entries]
        if not hit.any():
            continue
        entries, edge = entries[hit], np.repeat(edges, n)[hit]
        weight = cb[linked[edge]]
        of_a[v] += (weight * cx[entries]).sum()
        np.add.at(of_b, at[linked[edge]], ca[v] * cx[entries])
        np.add.at(of_x, spot[entries], ca[v] * weight)
    codes, weights = np.concatenate([keys, keys_2, names]), np.concatenate([of_a, of_b, of_x])
    return codes[weights > 0], weights[weights > 0]


def _added(parts: list) -> list:
    codes, t = (np.concatenate(x) for x in zip(*parts))
    codes, back = np.unique(codes, return_inverse=True)
    total = np.zeros(len(codes), dtype="int64")
    np.add.at(total, back, t)
    return [(codes, total)]


def _neighbour_lists(directed: DataFrame, edges: int) -> tuple[DataFrame, int]:
    """(part, data) and their number: the lists of neighbours, packed in groups of vertices and stored; an edge that comes twice is one."""
    cores = directed.sparkSession.sparkContext.defaultParallelism
    groups = max(math.ceil(edges / _GROUP_EDGES), min(math.ceil(math.sqrt(2 * cores)), 1 + edges // 1000))
    packed = written(directed.mapInArrow(_chunks(groups), _PACKED).groupBy("part").applyInArrow(_pack_lists, _PACKED), "lists")
    return cut_lineage(packed.repartitionByRange(groups, "part")), groups


def _ends(packed: DataFrame) -> DataFrame:
    """(code, near, near_pairs): ids of neighbouring vertices, and pairs of them within one vertex, as groups of lists count them."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                a, ca, b, cb = (c.to_numpy() for c in pa.ipc.open_stream(data.as_buffer()).read_all().columns)
                codes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                other = np.concatenate([cb, ca])
                near, inner = np.zeros(len(codes), dtype="int64"), np.zeros(len(codes), dtype="int64")
                np.add.at(near, back, other)
                np.add.at(inner, back, other * (other - 1) // 2)
                yield from pa.table({"code": codes, "near": near, "near_pairs": inner}).to_batches(max_chunksize=1 << 16)

    return packed.mapInArrow(run, "code long, near long, near_pairs long")


def _triangles(packed: DataFrame, groups: int) -> DataFrame:
    """(code, t): what tasks counted of the triangles of each vertex, copies of the other two multiplied out.

    A cartesian product reads every two groups of neighbour lists from the checkpoint folder, so no list travels with the edges that ask for it.
    A task compares many groups and adds up what it counts, so its counts number no more than the vertices.
    """
    cores = packed.sparkSession.sparkContext.defaultParallelism
    met = packed.select(F.col("data").alias("one")).hint("shuffle_replicate_nl").crossJoin(packed.select(F.col("data").alias("two")))
    met = met.coalesce(max(1, min(groups * groups, max(groups, 4 * cores))))

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for one, two in zip(batch.column("one"), batch.column("two")):
                found.append(_closed(_lists(one), _lists(two)))
                held += len(found[-1][0])
                if held > _COUNTS:
                    found = _added(found)
                    held = 0
        for codes, t in _added(found) if found else ():
            yield from pa.table({"code": codes, "t": t}).to_batches(max_chunksize=1 << 16)

    return met.mapInArrow(run, "code long, t long")


def clustering_coefficients(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient); a degree below 2 counts 0.

    Where ``vertices`` has a column ``copies``, a vertex stands for so many ids that are linked with each other, and the
    row holds what each of them has; their edges and triangles are counted in closed form and never listed.
    Edges are directed from the lower to the higher (number of neighbours, id), which bounds
    every neighbour list by sqrt(2 * edges); only closed triangles of vertices are emitted.
    """
    weighed = "copies" in vertices.columns
    vertices = vertices.select("id", (F.col("copies") if weighed else F.lit(1)).cast("long").alias("copies"))
    pairs = edges.select("src", "dst")
    # an edge that comes twice only shifts the order of its ends here; it is dropped where lists are packed
    around = cut_lineage(_both_ways(pairs).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")).join(vertices, "id"))
    around = written(around.withColumn("code", F.monotonically_increasing_id()), "around")
    rows, twice = around.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    one = around.select(F.col("id").alias("src"), F.col("d").alias("d1"), F.col("copies").alias("c1"), F.col("code").alias("k1"), F.col("d").alias("w"))
    two = around.select(F.col("id").alias("dst"), F.col("d").alias("d2"), F.col("copies").alias("c2"), F.col("code").alias("k2"), F.col("d").alias("w"))
    if rows <= _VERTICES:
        ranked = pairs.join(F.broadcast(one), "src").join(F.broadcast(two), "dst")
    else:
        ranked = lookup(lookup(pairs, one, ["src"], "w", total=twice), two, ["dst"], "w", total=twice)
    forward = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    low = F.struct(F.col("c1").alias("c"), F.col("k1").alias("k"))
    high = F.struct(F.col("c2").alias("c"), F.col("k2").alias("k"))
    directed = ranked.select(F.when(forward, low).otherwise(high).alias("x"), F.when(forward, high).otherwise(low).alias("y")).select(
        F.col("x.k").alias("a"), F.col("x.c").alias("ca"), F.col("y.k").alias("b"), F.col("y.c").alias("cb")
    )
    packed, groups = _neighbour_lists(directed, twice // 2)
    names = around.select("id", "code")
    near = _ends(packed).groupBy("code").agg(F.sum("near").alias("near"), F.sum("near_pairs").alias("near_pairs")).join(names, "code")
    near = near.groupBy("id").agg(F.sum("near").alias("near"), F.sum("near_pairs").alias("near_pairs"))
    triangles = _triangles(packed, groups).groupBy("code").agg(F.sum("t").alias("triangles")).join(names, "code").drop("code")
    zero = F.lit(0).cast("long")
    n, s, p = F.col("copies"), F.coalesce("near", zero), F.coalesce("near_pairs", zero)
    own = F.expr("(copies - 1) * (copies - 2) div 2")
    counted = vertices.join(near, "id", "left").join(triangles, "id", "left").select(
        "id", (n - 1 + s).alias("degree"), (own + (n - 1) * s + p + F.coalesce("triangles", zero)).alias("triangles")
    )
    d, t = F.col("degree"), F.col("triangles")
    return counted.select("id", "degree", "triangles", F.when(d >= 2, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def density(nodes, edges):
    return F.when(nodes > 1, 2.0 * edges / (nodes * (nodes - 1))).otherwise(0.0)


def analyze_network(
    vertices: DataFrame, edges: DataFrame, min_size: int = config.CAMPAIGN_MIN_SIZE, named: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of at least ``min_size`` ids, their members, and graph-wide metrics.

    With weighted vertices (``factorised_graph``) every figure is that of the ids; ``named`` then gives the members their ids.
    """
    weighed = vertices.select("id", (F.col("copies") if "copies" in vertices.columns else F.lit(1)).cast("long").alias("copies"))
    members = cut_lineage(
        clustering_coefficients(weighed, edges)
        .join(connected_components(edges.select("src", "dst"), weighed), "id")
        .join(weighed, "id")
    )
    n = F.sum("copies")
    ends = (F.sum(F.col("degree") * F.col("copies")) / 2).cast("long")
    mean = F.sum(F.col("coefficient") * F.col("copies")) / n
    shape = members.groupBy("component").agg(n.alias("size"), F.count("*").alias("weight"), ends.alias("edges"), mean.alias("avg_clustering"))
    large = shape.where(F.col("size") >= min_size)
    components = large.select(
        "component", "size", "edges", density(F.col("size"), F.col("edges")).alias("density"), "avg_clustering"
    )
    reported = lookup(members.select("id", "component"), large.select("component", "weight"), ["component"], "weight")
    totals = members.agg(
        n.alias("total_nodes"),
        ends.alias("total_edges"),
        F.count_if(F.col("id") == F.col("component")).alias("number_of_components"),
        mean.alias("avg_clustering"),
    )
    metrics = totals.withColumn("density", density(F.col("total_nodes"), F.col("total_edges")))
    return components, reported if named is None else of_ids(reported, named), metrics
