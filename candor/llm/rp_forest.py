"""Near-duplicate vectors by a forest of random-projection trees (operator 8).

Every tree splits its rows again and again at the median of a random projection;
rows near the split go to both sides. Vectors meet only inside leaves of equal
label, where cosines are verified. Links found in several leaves count in the
first of them alone, so a leaf returns sums and a spanning forest, never pairs.

The upper levels of all trees are fitted on a bounded sample and sent to the
tasks. Leaves that are still too large are split further level by level with
medians that Spark computes; what no projection can split meets in blocks.

Splitting parts a group of vectors that nearly all link to each other, so rows
around the dense places of the sample never enter the trees. They belong to the
nearest dense centre, their home, in shells by their angle to it. Angles are a
metric, so shells decide exactly which pairs link for certain (the angles add up to
the threshold's at most), which cannot link, and which are compared in blocks.
Every pair with a row of a home is settled this way; trees settle all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.vectors import by_length, usable
from candor.operators.graph import connected_components
from candor.operators.skew import lookup
from candor.session import written

THRESHOLD = 0.93
TREES = 16
SAMPLE = 32_768  # vectors that the upper levels are fitted on
SAMPLE_LEAF = 16  # sampled vectors that a node of the upper levels keeps at least
LEAF_ROWS = 1024  # rows of one leaf or block that are compared at once
SPILL = 0.05  # share of a node's rows on either side of the median that go to both children
DENSE_SAMPLE = 4  # sampled neighbours at least that make a place dense (or a quarter of a leaf's share of the sample)
SHELLS = 32  # of a home, between its centre and the threshold's angle
SLACK = 1e-6  # radians that rounding may move an angle
LEVELS = 48  # of a tree at most; larger leaves than LEAF_ROWS are then compared in blocks


def direction(tree: int, level: int, length: int) -> np.ndarray:
    """Unit vector that a tree projects on at one level."""
    v = np.random.default_rng([tree, level, length]).normal(size=length)
    return v / np.linalg.norm(v)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_tree(x: np.ndarray, tree: int, leaf: int = SAMPLE_LEAF, spill: float = SPILL) -> dict[int, tuple[float, float]]:
    """Split bands (low, high) by node; node i has the children 2i (left) and 2i + 1."""
    bands, todo = {}, [(1, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if len(rows) < 2 * leaf or level >= 30:
            continue
        p = x[rows] @ direction(tree, level, x.shape[1])
        low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
        left, right = rows[p <= high], rows[p >= low]
        if max(len(left), len(right)) >= len(rows):
            continue
        bands[node] = float(low), float(high)
        todo += [(2 * node, left, level + 1), (2 * node + 1, right, level + 1)]
    return bands


def leaves(x: np.ndarray, tree: int, bands: dict[int, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every row in a tree, several times where it spills over."""
    found_row, found_leaf = [], []
    now = {1: np.arange(len(x))}
    level = 0
    while now:
        following: dict[int, np.ndarray] = {}
        ahead = x @ direction(tree, level, x.shape[1])
        for node, rows in now.items():
            if node not in bands:
                found_row.append(rows)
                found_leaf.append(np.full(len(rows), node, np.int64))
                continue
            low, high = bands[node]
            p = ahead[rows]
            following[2 * node], following[2 * node + 1] = rows[p <= high], rows[p >= low]
        now = {n: r for n, r in following.items() if len(r)}
        level += 1
    return np.concatenate(found_row), np.concatenate(found_leaf)


def route(rows: DataFrame, forests, trees: int) -> DataFrame:
    """(id, weight, label, vector, tree, level, cells): the leaves of every vector; ``cells`` packs them for all trees."""
    forests = rows.sparkSession.sparkContext.broadcast(forests)

    def task(batches):
        for batch in batches:
            for at, x in by_length(batch.column(3)):
                x = unit(x)
                bands = forests.value.get(x.shape[1], [{}] * trees)
                spots = [leaves(x, t, bands[t]) for t in range(trees)]
                row = np.concatenate([s[0] for s in spots])
                tree = np.repeat(np.arange(trees), [len(s[0]) for s in spots])
                leaf = np.concatenate([s[1] for s in spots])
                order = np.argsort(row, kind="stable")
                row, tree, leaf = row[order], tree[order], leaf[order]
                part = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(4)), pa.array(tree, pa.int32()), pa.array(leaf)],
                    names=["id", "weight", "label", "vector", "tree", "node"],
                )

    return rows.select("id", "weight", "label", "vector").mapInArrow(
        task, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.select('id', 'weight', 'label', 'vector').schema)}, tree int, node long"
    )


def split_large(spots: DataFrame, leaf_rows: int, spill: float) -> DataFrame:
    """Split cells above ``leaf_rows`` level by level; adds ``rows``, the size of each cell."""
    settled, rounds = [], 0
    while True:
        sizes = written(spots.groupBy("cell").agg(F.count("*").alias("rows")), "forest-sizes")
        large = sizes.where(F.col("rows") > leaf_rows)
        sized = lookup(spots, sizes.withColumn("w", F.col("rows")), ["cell"], "w")
        if rounds >= LEVELS or large.isEmpty():
            settled.append(sized)
            break
        sized = written(sized, "forest-level")
        settled.append(sized.where(F.col("rows") <= leaf_rows))
        open_ = _projected(sized.where(F.col("rows") > leaf_rows).drop("rows"), 1000 + rounds)
        middle = open_.groupBy("cell").agg(
            F.percentile_approx("p", [0.5 - spill, 0.5 + spill], 1000).alias("band"), F.count("*").alias("w"),
            F.min("p").alias("least"), F.max("p").alias("most"),
        )
        both = lookup(open_, middle, ["cell"], "w")
        stuck = F.col("band")[0] <= F.col("least"), F.col("band")[1] >= F.col("most")
        children = F.when(stuck[0] | stuck[1], F.array(F.lit(2))).otherwise(
            F.array_compact(F.array(F.when(F.col("p") <= F.col("band")[1], 0), F.when(F.col("p") >= F.col("band")[0], 1)))
        )
        spots = written(
            both.withColumn("child", F.explode(children))
            .withColumn("cell", F.xxhash64("cell", "child"))
            .select("id", "weight", "label", "vector", "tree", "cell"),
            "forest-split",
        )
        rounds += 1
    result = settled[0]
    for s in settled[1:]:
        result = result.unionByName(s)
    return result


def _projected(rows: DataFrame, level: int) -> DataFrame:
    names = rows.columns
    at, tree_at = names.index("vector"), names.index("tree")

    def task(batches):
        for batch in batches:
            p = np.zeros(batch.num_rows)
            tree = np.asarray(batch.column(tree_at))
            for spots, x in by_length(batch.column(at)):
                x = unit(x)
                for t in np.unique(tree[spots]).tolist():
                    own = tree[spots] == t
                    p[spots[own]] = x[own] @ direction(t, level, x.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, "p"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(task, f"{kinds}, p double")


def verify(units: DataFrame, threshold: float) -> DataFrame:
    """(id, links, other): new links per vector and a spanning forest, for every unit of at most two blocks."""
    dealt = units.repartition("unit").sortWithinPartitions("unit", "id")
    columns = ["unit", "id", "weight", "vector", "rank", "cells", "block", "across"]

    def work(rows):
        ids = np.array([r[1] for r in rows], np.int64)
        weight = np.array([r[2] for r in rows], np.float64)
        x = unit(np.array([r[3] for r in rows], float))
        rank = rows[0][4]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if rows[0][7]:
            block = np.array([r[6] for r in rows])
            near &= block[:, None] != block[None, :]
        if not near.any():
            return []
        # pairs that share a leaf which comes before this one in the order of all leaves are counted there
        earlier = [[c for c in r[5] if c < rank] for r in rows]
        names = {c: i for i, c in enumerate(sorted({c for e in earlier for c in e}))}
        before = np.zeros((len(rows), len(names)), np.float32)
        for i, e in enumerate(earlier):
            before[i, [names[c] for c in e]] = 1
        fresh = near & ~((before @ before.T) > 0)
        links = (fresh * weight).sum(1)
        found = [(i, int(n), None) for i, n in zip(ids.tolist(), links) if n]
        found += [(int(ids[a]), 0, int(ids[b])) for a, b in zip(*spanning(near))]
        return found

    def task(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in columns)):
                if r[0] != now:
                    out += work(held) if len(held) > 1 else []
                    now, held = r[0], []
                held.append(r)
            if out:
                yield _found(out)
        if len(held) > 1 and (out := work(held)):
            yield _found(out)

    return dealt.select(*columns).mapInArrow(task, "id long, links long, other long")


def _found(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["id", "links", "other"]
    )


def dense_centres(x: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Unit centres of the places in a sample where a vector links to ``least`` others that no earlier centre covers."""
    counts = np.concatenate([(x[i : i + 256] @ x.T >= threshold).sum(1) for i in range(0, len(x), 256)]) - 1
    free, centres = np.ones(len(x), bool), []
    for i in np.argsort(-counts, kind="stable")[: int((counts >= least).sum())].tolist():
        if not free[i]:
            continue
        own = free & (x @ x[i] >= threshold)
        if own.sum() <= least:
            continue
        middle = x[own].mean(0)
        middle = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-6 else x[i]
        centres.append(middle)
        free[x @ middle >= threshold] = False
        free[i] = False
    return np.array(centres).reshape(-1, x.shape[1])


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def assign(rows: DataFrame, homes: dict, reach: float) -> DataFrame:
    """Adds ``home`` (number of the nearest centre within ``reach``, else -1) and ``shell``, the angle in steps."""
    homes = rows.sparkSession.sparkContext.broadcast(homes)
    names = rows.columns
    at, group_at = names.index("vector"), names.index("group")

    def task(batches):
        for batch in batches:
            home, shell = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.int32)
            group = np.asarray(batch.column(group_at))
            for spots, x in by_length(batch.column(at)):
                for g in np.unique(group[spots]).tolist():
                    if (g, x.shape[1]) not in homes.value:
                        continue
                    first, centres = homes.value[g, x.shape[1]]
                    own = np.flatnonzero(group[spots] == g)
                    for part in np.array_split(own, len(own) // 512 + 1):
                        if len(part):
                            far = angles(unit(x[part]), centres)
                            best = far.argmin(1)
                            far = far[np.arange(len(part)), best]
                            near = far + SLACK <= reach
                            home[spots[part[near]]] = first + best[near]
                            # slack moves a row outwards, so shells never promise too much
                            shell[spots[part[near]]] = ((far[near] + SLACK) * (SHELLS / reach)).astype(np.int32).clip(0, SHELLS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(shell)], names=[*names, "home", "shell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(task, f"{kinds}, home int, shell int")


def visits(rows: DataFrame, homes: dict, outer: dict[int, int], reach: float) -> DataFrame:
    """(id, weight, vector, home, low): rows that may link with shells from ``low`` on of a home that is not theirs.

    Of two homes the one with the higher number is visited, so two rows meet once.
    """
    shared = rows.sparkSession.sparkContext.broadcast((homes, outer))
    columns = ["id", "weight", "vector", "group", "home"]

    def task(batches):
        homes, outer = shared.value
        for batch in batches:
            group, home = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            for spots, x in by_length(batch.column(2)):
                for g in np.unique(group[spots]).tolist():
                    if (g, x.shape[1]) not in homes:
                        continue
                    first, centres = homes[g, x.shape[1]]
                    numbers = first + np.arange(len(centres))
                    last = np.array([outer.get(n, -1) for n in numbers.tolist()])
                    own = np.flatnonzero(group[spots] == g)
                    for part in np.array_split(own, len(own) // 512 + 1):
                        if not len(part):
                            continue
                        low = np.floor((angles(unit(x[part]), centres) - reach - 2 * SLACK) * (SHELLS / reach)).clip(0).astype(np.int32)
                        row, to = np.nonzero((low <= last) & (home[spots[part]][:, None] < numbers))
                        if len(row):
                            taken = batch.take(pa.array(spots[part[row]]))
                            yield pa.RecordBatch.from_arrays(
                                [*(taken.column(i) for i in range(3)), pa.array(numbers[to].astype(np.int32)), pa.array(low[row, to])],
                                names=["id", "weight", "vector", "home", "low"],
                            )

    return rows.select(*columns).mapInArrow(task, "id long, weight long, vector array<double>, home int, low int")


def blocks_of(sizes: dict[int, dict[int, int]], block_rows: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per home its (lowest shell, highest shell, first block, blocks): thin shells share a block, thick ones have several."""
    found = {}
    for home, counts in sizes.items():
        spans, held = [], 0
        for shell in sorted(counts):
            if spans and held + counts[shell] <= block_rows:
                spans[-1][1], held = shell, held + counts[shell]
            else:
                spans.append([shell, shell, 0, 0])
                held = counts[shell]
            spans[-1][3] = -(-held // block_rows)
        first = 0
        for span in spans:
            span[2] = first
            first += span[3]
        found[home] = [tuple(s) for s in spans]
    return found


def certain(a, b):
    """Whether rows of two shells of a home link in any case: the outer edges' angles add up to the threshold's at most."""
    return a + b + 2 <= SHELLS


def meetings(members: DataFrame, visitors: DataFrame, spans: dict, chunks: dict[int, int]) -> DataFrame:
    """(unit, self, side, id, weight, shell, vector): two blocks to compare, or one with itself."""
    spark = members.sparkSession
    spark_spans = F.broadcast(spark.createDataFrame(
        [(h, s, first, n, hi) for h, v in spans.items() for lo, hi, first, n in v for s in range(lo, hi + 1)],
        "home int, shell int, first int, parts int, high int",
    ))
    whole = F.broadcast(spark.createDataFrame(
        [(h, [(hi, first, n) for _, hi, first, n in v], chunks.get(h, 0)) for h, v in spans.items()],
        "home int, spans array<struct<high int, first int, parts int>>, chunks int",
    ))

    def all_blocks(wanted):
        kept = F.filter("spans", wanted)
        return F.flatten(F.transform(kept, lambda s: F.sequence(s["first"], s["first"] + s["parts"] - 1)))

    placed = members.join(spark_spans, ["home", "shell"]).join(whole, "home").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("id"), "parts").cast("int")
    )
    mates = F.transform(
        all_blocks(lambda s: s["high"] + F.col("high") + 2 > SHELLS),
        lambda b: F.struct(
            F.xxhash64(F.lit(0), "home", F.least("block", b), F.greatest("block", b)).alias("unit"),
            (b == F.col("block")).alias("self"), (b < F.col("block")).cast("int").alias("side"),
        ),
    )
    hosts = F.when(F.col("chunks") > 0, F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.struct(F.xxhash64(F.lit(1), "home", "block", c).alias("unit"), F.lit(False).alias("self"), F.lit(0).alias("side")),
    ))
    columns = ["m.unit", "m.self", "m.side", "id", "weight", "shell", "vector"]
    hosting = placed.withColumn("m", F.explode(F.concat(mates, F.coalesce(hosts, F.array().cast("array<struct<unit:bigint,self:boolean,side:int>>")))))
    chunk = F.pmod(F.xxhash64("id"), "chunks").cast("int")
    coming = (
        visitors.join(whole, "home")
        .withColumn("b", F.explode(all_blocks(lambda s: s["high"] >= F.col("low"))))
        .withColumn("m", F.struct(F.xxhash64(F.lit(1), "home", "b", chunk).alias("unit"), F.lit(False).alias("self"), F.lit(1).alias("side")))
        .withColumn("shell", F.lit(SHELLS))
    )
    return hosting.select(*columns).unionByName(coming.select(*columns))


def compare(units: DataFrame, threshold: float) -> DataFrame:
    """(id, links, other) like ``verify``, for the units of ``meetings``; certain links are not counted here."""
    dealt = units.repartition("unit").sortWithinPartitions("unit", "side", "id")

    def work(pieces):
        rows = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        ids, weight, side = np.asarray(rows.column(3)), np.asarray(rows.column(4), np.float64), np.asarray(rows.column(2))
        alone = rows.column(1)[0].as_py()
        if len(ids) < 2 or not alone and side[0] == side[-1]:
            return None
        shell = np.asarray(rows.column(5))
        x = unit(by_length(rows.column(6))[0][1])
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        near &= ~certain(shell[:, None], shell[None, :])
        if not alone:
            near &= side[:, None] != side[None, :]
        links = near @ weight
        some = np.flatnonzero(links)
        a, b = spanning(near)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], ids[a]])),
                pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(a), np.int64)])),
                pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[b]]), mask=np.arange(len(some) + len(a)) < len(some)),
            ],
            names=["id", "links", "other"],
        )

    def task(batches):
        now, held = None, []
        for batch in batches:
            name = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and name[start] != now:
                    if (out := work(held)) is not None:
                        yield out
                    held = []
                now = name[start]
                held.append(batch.slice(start, end - start))
        if held and (out := work(held)) is not None:
            yield out

    return dealt.mapInArrow(task, "id long, links long, other long")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a spanning forest of a symmetric boolean matrix."""
    free = np.ones(len(near), bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in np.flatnonzero(near.any(1)).tolist():
        if free[root]:
            free[root] = False
            queue = [root]
            while queue:
                at = queue.pop()
                other = np.flatnonzero(near[at] & free)
                free[other] = False
                a.append(np.full(len(other), at))
                b.append(other)
                queue += other.tolist()
    return np.concatenate(a), np.concatenate(b)


def settle_homes(assigned: DataFrame, homes: dict, threshold: float, reach: float, block_rows: int) -> DataFrame:
    """(id, links, other) of all pairs with a row of a home; only figures per home and shell reach the driver."""
    members = assigned.where("home >= 0")
    shells = members.groupBy("home", "shell").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"), F.min("id").alias("least"))
    sizes: dict[int, dict[int, int]] = {}
    sure, anchors = [], {}
    heavy: dict[int, dict[int, int]] = {}
    for r in sorted(shells.collect(), key=lambda r: (r["home"], r["shell"])):
        sizes.setdefault(r["home"], {})[r["shell"]] = r["rows"]
        heavy.setdefault(r["home"], {})[r["shell"]] = r["weight"]
        anchors.setdefault(r["home"], (r["shell"], r["least"]))  # smallest id of the innermost shell
    for home, counts in heavy.items():
        inner, least = anchors[home]
        for shell in counts:
            if certain(shell, inner):
                sure.append((home, shell, sum(w for s, w in counts.items() if certain(s, shell)), bool(certain(shell, shell)), least))
    spark = assigned.sparkSession
    known = spark.createDataFrame(sure, "home int, shell int, links long, within boolean, anchor long")
    promised = members.join(F.broadcast(known), ["home", "shell"])
    own = promised.select("id", (F.col("links") - F.when(F.col("within"), F.col("weight")).otherwise(0)).alias("links"), F.lit(None).cast("long").alias("other"))
    star = promised.where("id <> anchor").select("id", F.lit(0).cast("long").alias("links"), F.col("anchor").alias("other"))
    outer = {home: max(counts) for home, counts in sizes.items()}
    visitors = written(visits(assigned, homes, outer, reach), "forest-visits")
    chunks = {r["home"]: -(-r["count"] // block_rows) for r in visitors.groupBy("home").count().collect()}
    units = meetings(members.select("id", "weight", "home", "shell", "vector"), visitors, blocks_of(sizes, block_rows), chunks)
    return own.where("links > 0").unionByName(star).unionByName(compare(units, threshold))


def near_duplicates(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    spill: float = SPILL,
) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` and ``kept``.

    Rows of equal, non-null label link when their cosine is at least ``threshold``;
    vectors of unequal length do not meet. Vectors that are null, zero or hold null
    or non-finite components, and rows without a label or an id, link with nothing
    and are their own component. Equal vectors of a label are one node that counts
    its rows; ids are taken to be unique otherwise, and repeated rows count as
    others. Other columns named like the new ones are replaced.
    """
    taken = ["n_links", "component_id", "kept"]
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    whole = df.select(*rest, (usable(vector) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()).alias("_ok"))
    good = whole.where("_ok").select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    folded = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    rows = written(folded.select("id", "weight", "label", "vector"), "forest-rows")
    total = max(rows.count(), 1)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector", F.xxhash64("label").alias("group")).toArrow()
    reach = math.acos(min(max(threshold, -1.0), 1.0))
    least = max(DENSE_SAMPLE, leaf_rows * min(SAMPLE, total) // (4 * total))
    homes, first, outside = {}, 0, {}
    group = np.asarray(sample.column("group"))
    for spots, x in by_length(sample.column("vector")):
        x, free = unit(x), np.ones(len(spots), bool)
        for g in np.unique(group[spots]).tolist() if reach > 1e-3 else []:
            own = np.flatnonzero(group[spots] == g)
            centres = dense_centres(x[own], threshold, least) if len(own) > least else []
            if len(centres):
                homes[g, x.shape[1]] = first, centres
                first += len(centres)
                free[own] = (x[own] @ centres.T).max(1) < threshold
        outside[x.shape[1]] = x[free]
    homed = None
    if homes:
        assigned = written(assign(rows.withColumn("group", F.xxhash64("label")), homes, reach), "forest-homes")
        homed = settle_homes(assigned, homes, threshold, reach, leaf_rows)
        open_rows = assigned.where("home < 0")
        total = max(open_rows.count(), 1)
    else:
        open_rows = rows
    leaf = max(SAMPLE_LEAF, leaf_rows * min(SAMPLE, total) // (2 * total))
    forests = {length: [fit_tree(x, t, leaf, spill) for t in range(trees)] for length, x in outside.items()}
    spots = route(open_rows, forests, trees).withColumn("cell", F.xxhash64("label", F.size("vector"), "tree", "node")).drop("node")
    spots = written(spots, "forest-leaves")
    cells = written(split_large(spots, leaf_rows, spill), "forest-cells")
    # the order of all leaves: by tree, then by name
    rank = F.col("tree").cast("long") * F.lit(1 << 56) + F.pmod(F.col("cell"), F.lit(1 << 56))
    own = cells.groupBy("id").agg(F.sort_array(F.collect_set(rank)).alias("cells"))  # a few per tree
    parts = F.ceil(F.col("rows") / leaf_rows).cast("int")
    placed = cells.where("rows > 1").withColumn("rank", rank).withColumn("parts", parts)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    # a cell of several blocks: every block with itself and with every other one
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: F.struct(F.least("block", b).alias("a"), F.greatest("block", b).alias("b")))
    units = (
        placed.withColumn("mate", F.explode(mates))
        .withColumn("unit", F.xxhash64("cell", "mate"))
        .withColumn("across", F.col("mate.a") != F.col("mate.b"))
        .join(own, "id")
    )
    found = verify(units, threshold)
    found = written(found if homed is None else found.unionByName(homed), "forest-links")
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("_links"))
    edges = found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    root = connected_components(edges).select("id", F.col("component").alias("_root"))
    nodes = rows.join(links, "id", "left").join(root, "id", "left").select(
        "label", "vector", "weight",
        (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("_root", "id").alias("component_id"),
    )
    nodes = written(nodes, "forest-nodes")
    linked = lookup(
        whole.where("_ok").withColumn("_label", F.col(label)).withColumn("_vector", F.col(vector).cast("array<double>")),
        nodes.withColumnRenamed("label", "_label").withColumnRenamed("vector", "_vector"),
        ["_label", "_vector"],
        "weight",
    ).drop("_label", "_vector")
    alone = whole.where("not _ok").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col(vec_id).cast("long"))
    both = linked.unionByName(alone).drop("_ok")
    return both.withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(True)))
