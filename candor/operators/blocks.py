"""Blocked exact cosine joins.

Identical vectors are folded into one representative with a copy count before
anything is compared. Rows are placed in cells of a k-d tree over a few principal
coordinates of a sample. Coordinates never stretch distances, and the length of what they leave
out is one coordinate more, so the gap between a row and the bounding box of a cell bounds,
exactly, which cells can hold a row within the threshold. Cells above the block size are split by
id hash, and inside a block pair the same bound skips whole tiles. Every qualifying pair meets in
exactly one block pair. A kernel inside the task reduces the block pair to what the operator
needs (counts, star edges, labels), so all pairs are only ever emitted when the pair list itself is the result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor import config
from candor.functions.vectors import unit
from candor.session import cut_lineage, written

_TILE = 128  # rows of a tile inside a block
_COORDINATES = 8  # principal coordinates that cells and tiles are bounded in
_DIGITS = 12  # cosines are compared and reported at this precision
_BLOCKS = 1 << 24  # block numbers per cell in a block code
_GRID_BLOCKS = 16  # blocks that one task holds of either side, at most
_GRID_BYTES = 96 << 20  # and their unpacked size
_GRID_HELD = 2_000_000  # result rows a task holds before it adds them up
_PLATFORMS = 64  # platforms of a task, at most, that are counted by products of matrices
_LIST_ROWS = 1 << 19  # listed pairs a task holds before it hands them on


def vector_key(vector) -> F.Column:
    """128-bit key of a vector; equal vectors share it."""
    return F.concat(F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.lit(17), vector)))


def unit_members(df: DataFrame, id: str, vector: str, keep=()) -> DataFrame:
    """(id, vkey, vec, *keep) with normalised vectors; zero and null vectors are left out."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(v.isNotNull()).select(F.col(id).cast("string").alias("id"), *keep, vector_key(v).alias("vkey"), unit(v).alias("vec"))
    return rows.where(F.exists("vec", lambda x: x != 0))


def _slim(values: np.ndarray) -> bytes:
    """A vector as its distinct values and compressed places in them; one of 256 values or more stays as it is."""
    found, codes = np.unique(np.ascontiguousarray(values).view("int64"), return_inverse=True)
    if not 0 < len(found) < 256:
        return b"\0" + values.tobytes()
    return bytes([len(found)]) + found.tobytes() + zlib.compress(codes.astype("uint8").tobytes(), 1)


def _full(data: bytes) -> np.ndarray:
    n = data[0]
    if not n:
        return np.frombuffer(data, dtype="float64", offset=1)
    return np.frombuffer(data, dtype="float64", count=n, offset=1)[np.frombuffer(zlib.decompress(data[1 + 8 * n :]), dtype="uint8")]


def _slim_array(vectors: pa.Array) -> pa.Array:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    ends = np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    known = vectors.is_valid().to_pylist()
    return pa.array([_slim(v) if k else None for v, k in zip(np.split(flat, ends[:-1]), known)], pa.binary())


def _full_array(data: pa.Array) -> pa.Array:
    rows = [None if d is None else _full(d) for d in data.to_pylist()]
    ends = np.cumsum([0] + [0 if r is None else len(r) for r in rows]).astype("int32")
    flat = np.concatenate([np.zeros(0), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64()), mask=data.is_null())


def slim(df: DataFrame) -> DataFrame:
    """``df`` with ``vec`` as bytes, bit by bit the same after ``full``: what a shuffle writes. Bucket counts of a text take a fraction of their array."""
    return _converted(df, _slim_array, T.BinaryType())


def full(df: DataFrame) -> DataFrame:
    return _converted(df, _full_array, T.ArrayType(T.DoubleType()))


def _converted(df: DataFrame, convert, kind: T.DataType) -> DataFrame:
    # a step of its own: the optimizer may draw a function of a column into an aggregation, where Python cannot run
    def run(batches):
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("vec"), "vec", convert(batch.column("vec")))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, kind if f.name == "vec" else f.dataType) for f in df.schema]))


def _replaced(table: pa.Table, name: str, values) -> pa.Table:
    return table.set_column(table.column_names.index(name), name, values)


def _widened(table: pa.Table) -> pa.Table:
    """``table`` with its vectors in full."""
    return _replaced(table, "vec", _full_array(table.column("vec").combine_chunks()))


def representatives(members: DataFrame, scope: str | None = None) -> DataFrame:
    """One row per distinct vector (and scope): rep (smallest id), copies, vec.

    The copies of a vector are folded map-side, so a hot vector costs one row per task.
    """
    keys = ["vkey"] + ([scope] if scope else [])
    found = slim(members.select(*keys, "id", "vec")).groupBy(*keys).agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")
    )
    return full(found)


def id_chunks(members: DataFrame, scope: str | None = None, keep=(), chunk: int = 1000) -> DataFrame:
    """As ``representatives``, with the ids themselves: ``ids`` (structs of id and ``keep``), about ``chunk`` of the copies of a vector a row.

    Rows without an id are left out. Equal ids with one vector share a row. Vectors of more copies than a chunk number fewer than one in ``chunk`` rows.
    """
    keys = ["vkey"] + ([scope] if scope else [])
    rows = members.where("id is not null")
    # null scopes are a group like any other
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_copies")).where(F.col("_copies") > chunk)
    same = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_{k}") for k in keys], "_copies"))
    part = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("_copies") / chunk)))
    return (
        rows.join(hot, same, "left").groupBy(*keys, part.alias("part"))
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.collect_list(F.struct("id", *keep)).alias("ids"))
        .drop("part")
    )


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, 1))


def _split(at: np.ndarray, most: int) -> tuple[list, list[np.ndarray]]:
    """A k-d tree: median splits along the widest coordinate until no leaf has more than ``most`` rows.

    Returns nodes (coordinate, value, low child, high child), where a negative child is leaf -1 - child, and the rows of each leaf.
    """
    nodes, leaves = [], []

    def grow(rows):
        part = at[rows]
        k = int(part.var(axis=0).argmax()) if len(rows) else 0
        if len(rows) > most:
            cut = float(np.median(part[:, k]))
            low = part[:, k] <= cut
            if low.all():  # a median that is the largest value
                low = part[:, k] < cut
                cut = float(np.nextafter(cut, -np.inf))
            if low.any() and not low.all():
                me = len(nodes)
                nodes.append(None)
                nodes[me] = (k, cut, grow(rows[low]), grow(rows[~low]))
                return me
        leaves.append(rows)
        return -len(leaves)

    grow(np.arange(len(at)))
    return nodes, leaves


def _leaf_of(at: np.ndarray, nodes: list) -> np.ndarray:
    """Number of the leaf that each row falls into."""
    if not nodes:
        return np.zeros(len(at), dtype="int64")
    table = np.array(nodes, dtype="float64")
    k, cut, low, high = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int)
    node = np.zeros(len(at), dtype="int64")
    while True:
        inner = np.flatnonzero(node >= 0)
        if not len(inner):
            return -1 - node
        n = node[inner]
        node[inner] = np.where(at[inner, k[n]] <= cut[n], low[n], high[n])


def _gaps(low: np.ndarray, high: np.ndarray, low_2: np.ndarray, high_2: np.ndarray) -> np.ndarray:
    """Squared distance between boxes: every row of the first two arrays against every row of the others."""
    out = np.zeros((len(low), len(low_2)))
    for k in range(low.shape[1]):
        gap = np.maximum(low_2[None, :, k] - high[:, None, k], low[:, None, k] - high_2[None, :, k])
        out += np.maximum(gap, 0) ** 2
    return out


def _reach(threshold: float) -> float:
    """Squared distance of two unit vectors at the threshold, with room for rounding."""
    return 2 - 2 * max(-1.0, threshold) + 1e-6


def _box_cells(reps: DataFrame, n: int, threshold: float, block_rows: int, first: int) -> tuple[DataFrame, int]:
    """Add ``at``, ``own`` (cell and block of the row) and ``partners`` (blocks it has to meet); cells are numbered from ``first``."""
    wanted = min(config.MAX_PIVOTS, n)
    rows = reps.orderBy(F.xxhash64("vkey"), "vkey").limit(wanted).select("vec").collect()
    sample = np.array([r["vec"] for r in rows])
    centre = sample.mean(axis=0)
    axes = np.linalg.svd(sample - centre, full_matrices=False)[2][:_COORDINATES].T

    def coordinates(vectors: np.ndarray) -> np.ndarray:
        moved = vectors - centre
        main = moved @ axes
        rest = np.sqrt(np.maximum((moved * moved).sum(axis=1) - (main * main).sum(axis=1), 0))
        return np.column_stack([main, rest])

    cells = max(1, min(config.MAX_PIVOTS // 2, math.ceil(2 * n / block_rows)))
    nodes, leaves = _split(coordinates(sample), math.ceil(len(sample) / cells))

    @F.pandas_udf("at array<double>, cell int")
    def placed(vec: pd.Series) -> pd.DataFrame:
        at = coordinates(_matrix(vec)) if len(vec) else np.zeros((0, axes.shape[1] + 1))
        return pd.DataFrame({"at": list(at), "cell": _leaf_of(at, nodes).astype("int32")})

    celled = reps.withColumn("_at", placed("vec")).select("*", "_at.at", "_at.cell").drop("_at")  # not stored: the vectors are in ``reps``
    width = axes.shape[1] + 1
    low, high, blocks = np.full((len(leaves), width), np.inf), np.full((len(leaves), width), -np.inf), np.zeros(len(leaves), dtype="int64")
    bounds = [f(F.get("at", i)) for i in range(width) for f in (F.min, F.max)]
    for r in celled.groupBy("cell").agg(F.count("*"), *bounds).collect():
        low[r[0]], high[r[0]], blocks[r[0]] = r[2::2], r[3::2], -(-r[1] // block_rows)
    reach = _reach(threshold)
    codes = [(first + c) * _BLOCKS + np.arange(b, dtype="int64") for c, b in enumerate(blocks)]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def partners(at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype=object)
        rows = _matrix(at)
        near = _gaps(rows, rows, low, high) <= reach
        return pd.Series([np.concatenate([codes[c] for c in np.flatnonzero(row)]) for row in near])

    split = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(blocks, 1)]), F.col("cell") + 1)
    own = (F.col("cell").cast("long") + first) * F.lit(_BLOCKS) + F.pmod(F.xxhash64("rep", "vkey"), split)
    return celled.withColumn("own", own).withColumn("partners", partners("at")).drop("cell"), len(leaves)


def _scope_cells(reps: DataFrame, n: int, scope: str, block_rows: int, lengths: list[int]) -> DataFrame:
    """Cells by scope value: small scopes share cells by hash, a scope above ``block_rows`` rows has blocks of its own."""
    kind = F.xxhash64(scope, F.size("vec"))
    large = reps.groupBy(kind.alias("_kind")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block_rows)
    cells = max(1, math.ceil(2 * n / block_rows))
    length = F.array_position(F.array(*[F.lit(int(x)) for x in lengths]), F.size("vec")) - 1
    shared = length * F.lit(cells) + F.pmod(F.xxhash64(scope), F.lit(cells))
    parts = F.ceil(F.col("_rows") / block_rows)
    base = F.lit(1 << 62) + F.col("_kind").bitwiseAND((1 << 38) - 1) * F.lit(_BLOCKS)
    alone = F.col("_rows").isNotNull()
    return (
        reps.withColumn("_kind", kind)
        .join(F.broadcast(large), "_kind", "left")  # fewer than one in block_rows rows
        .withColumn("at", F.lit(None).cast("array<double>"))
        .withColumn("own", F.when(alone, base + F.pmod(F.xxhash64("rep", "vkey"), parts)).otherwise(shared))
        .withColumn("partners", F.when(alone, F.sequence(base, base + parts - 1)).otherwise(F.array(shared)))
        .drop("_kind", "_rows")
    )


def _tiles(rows: np.ndarray, at: np.ndarray | None):
    """(rows, lowest, highest coordinates) of the tiles of a block; one box without bounds where no coordinates are known."""
    if at is None:
        parts = [rows[i : i + _TILE * 8] for i in range(0, len(rows), _TILE * 8)]
        return parts, None, None
    parts = [rows[p] for p in _split(at[rows], _TILE)[1]]
    return parts, np.array([at[p].min(axis=0) for p in parts]), np.array([at[p].max(axis=0) for p in parts])


def _matches(vec, at, left, right, threshold, strict, same):
    """Index pairs at or above the threshold, one tile of rows against all tiles in reach at a time."""
    if not len(left) or not len(right):
        return
    parts, low, high = _tiles(left, at)
    others, low_2, high_2 = (parts, low, high) if same else _tiles(right, at)
    near_by = np.ones((len(parts), len(others)), dtype=bool) if at is None else _gaps(low, high, low_2, high_2) <= _reach(threshold)
    for t, li in enumerate(parts):
        if same:
            near_by[t, :t] = False  # met already
        met = np.flatnonzero(near_by[t])
        if not len(met):
            continue
        ri = np.concatenate([others[o] for o in met])
        sims = vec[li] @ vec[ri].T
        near = sims >= threshold - 1e-9
        if same and met[0] == t:  # a tile with itself: each pair once
            near[:, : len(li)] &= np.triu(np.ones((len(li), len(li)), dtype=bool), 1)
        a, b = np.nonzero(near)
        s = np.round(sims[a, b], _DIGITS)
        ok = s > threshold if strict else s >= threshold
        if ok.any():
            yield li[a[ok]], ri[b[ok]], s[ok]


def _group_matches(table: pa.Table, threshold, strict, by_scope):
    """Matching index pairs of one block pair; ``by_scope`` keeps pairs of one scope only."""
    vec = _array(table, "vec")
    at = None if table.column("at").null_count else _array(table, "at")
    own = table.column("own").to_numpy()
    same = own.min() == own.max()
    side = own == own.min()
    every = np.arange(table.num_rows)
    if not by_scope:
        yield from _matches(vec, at, every[side], every if same else every[~side], threshold, strict, same)
        return
    scope = table.column("scope").to_numpy()
    order = np.argsort(scope, kind="stable")
    cuts = np.flatnonzero(np.diff(scope[order])) + 1
    for part in np.split(order, cuts):
        left = part[side[part]]
        right = part if same else part[~side[part]]
        yield from _matches(vec, at, left, right, threshold, strict, same)


def _array(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def place(
    reps: DataFrame,
    threshold: float,
    scope: str | None = None,
    prune: str = "boxes",
    block_rows: int = config.BLOCK_ROWS,
) -> DataFrame:
    """Give every representative its block and the blocks it has to meet.

    ``reps`` has rep, vkey, copies, vec and is materialised by the caller. Any
    subset of the placed rows may be joined with any threshold from the given
    one upwards. ``prune`` picks the cells: around boxes, or by scope value.
    Vectors of different lengths never share a cell, so they do not match.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    # one row per embedding model's length
    sizes = {r[0]: r[1] for r in reps.groupBy(F.size("vec")).count().orderBy(F.size("vec")).collect()}
    if prune == "scope":
        return _scope_cells(reps, sum(sizes.values()), scope, block_rows, list(sizes) or [0])
    out, first = None, 0
    for length, n in sizes.items():
        placed, cells = _box_cells(reps.where(F.size("vec") == length), n, threshold, block_rows, first)
        out, first = placed if out is None else out.unionByName(placed), first + cells
    if out is not None:
        return out
    return reps.select("*", F.array().cast("array<double>").alias("at"), F.lit(0).cast("long").alias("own"), F.array().cast("array<bigint>").alias("partners"))


def blocked_join(
    placed: DataFrame,
    kernel,
    schema: str,
    threshold: float,
    strict: bool = False,
    scope: str | None = None,
    carry=(),
    prune: str = "boxes",
    total: str | None = None,
    scored=None,
) -> DataFrame:
    """Run ``kernel(table, matches)`` once per block pair and union the results.

    ``matches`` iterates over (i, j, cosine) index arrays into ``table``. A kernel returns its columns, or yields them part by part. With
    ``scope`` only rows of the same scope value match. ``carry`` names further
    columns the kernel reads. ``prune`` is that of ``place``: between boxes every row is shuffled once, into
    its packed block, and tasks read the blocks they compare; by scope, rows go to the few blocks of their scope.
    ``total`` names a result column that a task may add up over equal values of the others. ``scored`` lists the matches of two blocks, all of them by default.
    """
    code = F.xxhash64(scope) if scope else F.lit(0).cast("long")
    rows = slim(placed.select("rep", "copies", "vec", "at", code.alias("scope"), *carry, "own", *(["partners"] if prune == "scope" else [])))
    arrow_schema = _arrow_schema(schema)
    by_scope = scope is not None

    def as_tables(found):
        for columns in [found] if isinstance(found, dict) else found:
            yield pa.table({f.name: pa.array(columns[f.name], type=f.type) for f in arrow_schema}, schema=arrow_schema)

    def met(one: _Block, two: _Block):
        if by_scope:
            both = one.wide if one is two else pa.concat_tables([one.wide, two.wide])
            return as_tables(kernel(both, _group_matches(both, threshold, strict, True)))
        both = one.table if one is two else pa.concat_tables([one.table, two.table])
        return as_tables(kernel(both, (scored or _scored)(one, two, threshold, strict)))

    if prune == "boxes":
        fold = kernel if isinstance(kernel, CountFold) else None
        if fold is not None and by_scope:
            raise ValueError("counts are not kept by scope")
        return _grid_join(rows, met, schema, arrow_schema, threshold, strict, total, fold)

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        if lo != hi and own.min() == own.max():
            return arrow_schema.empty_table()  # only one side came through
        table = _widened(table)
        return pa.concat_tables([arrow_schema.empty_table(), *as_tables(kernel(table, _group_matches(table, threshold, strict, by_scope)))])

    sides = rows.withColumn("other", F.explode("partners")).drop("partners")
    sides = sides.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")
    return sides.groupBy("lo", "hi").applyInArrow(run, schema)


def _tiled(table: pa.Table, parts: np.ndarray | None = None) -> pa.Table:
    """The rows of a block tile by tile, with the number of the ``tile``; a tile lies within one of ``parts``."""
    at = _array(table, "at")
    every = np.arange(table.num_rows)
    groups = [every] if parts is None else [every[parts == x] for x in np.unique(parts)]
    tiles = [g[t] for g in groups for t in _split(at[g], _TILE)[1]]
    number = np.repeat(np.arange(len(tiles), dtype="int32"), [len(t) for t in tiles])
    table = table.drop_columns(["tile"]) if "tile" in table.column_names else table
    return table.take(pa.array(np.concatenate(tiles))).append_column("tile", pa.array(number))


def _pack(table: pa.Table) -> pa.Table:
    """All rows of one block as one row: its box, the length of its vectors and the rows as a compressed Arrow stream."""
    at, width, raw = _array(table, "at"), len(table.column("vec")[0]), table.nbytes
    table = _replaced(table, "vec", _slim_array(table.column("vec").combine_chunks()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table.combine_chunks())
    return pa.table({
        "own": pa.array([table.column("own")[0].as_py()], pa.int64()),
        "width": pa.array([width], pa.int64()),
        "raw": pa.array([raw], pa.int64()),
        "low": pa.array([at.min(axis=0)], pa.list_(pa.float64())),
        "high": pa.array([at.max(axis=0)], pa.list_(pa.float64())),
        "data": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
    })


class _Block:
    """An unpacked block; its vectors are unpacked when they are first read, and forgotten by ``rest``."""

    def __init__(self, own: int, width: int, low, high, table: pa.Table):
        self.own, self.width, self.rows = own, width, table.num_rows
        self.low, self.high = (np.array(box, dtype="float64")[None, :] for box in (low, high))
        self.packed, self.table = table, table.drop_columns(["vec"])
        at = _array(table, "at")
        self.starts = np.flatnonzero(np.diff(table.column("tile").to_numpy(), prepend=-1))
        self.ends = np.append(self.starts[1:], self.rows)
        self.tile_low, self.tile_high = np.minimum.reduceat(at, self.starts), np.maximum.reduceat(at, self.starts)
        self._vec = self._half = self._wide = None

    @classmethod
    def of(cls, packed) -> _Block:
        box = [packed[side].as_py() for side in ("low", "high")]
        return cls(packed["own"].as_py(), packed["width"].as_py(), *box, pa.ipc.open_stream(packed["data"].as_buffer()).read_all())

    @property
    def vec(self) -> np.ndarray:
        if self._vec is None:
            kept = self.packed.column("vec").combine_chunks()
            full_rows = _full_array(kept) if pa.types.is_binary(kept.type) else kept
            self._vec = full_rows.flatten().to_numpy(zero_copy_only=False).reshape(self.rows, -1)
        return self._vec

    @property
    def half(self) -> np.ndarray:
        """The vectors in single precision."""
        if self._half is None:
            self._half = self.vec.astype("float32")
        return self._half

    @property
    def wide(self) -> pa.Table:
        """All columns, the vectors among them."""
        if self._wide is None:
            self._wide = _widened(self.packed).drop_columns(["tile"])
        return self._wide

    def rest(self) -> None:
        self._vec = self._half = self._wide = None


def _tile_runs(one: _Block, two: _Block, reach: float, skip=None):
    """(tile of ``one``, begin, end): runs of rows of ``two`` that the tile has to meet; inside a block every two tiles meet once.

    ``skip(tile)`` marks tiles of ``two`` that need no comparison with it.
    """
    near = _gaps(one.tile_low, one.tile_high, two.tile_low, two.tile_high) <= reach
    for t in range(len(one.starts)):
        wanted = near[t]
        if one is two:
            wanted[:t] = False
        if skip is not None and wanted.any():
            wanted = wanted & ~skip(t)
        met = np.flatnonzero(wanted)
        for run in np.split(met, np.flatnonzero(np.diff(met) != 1) + 1) if len(met) else ():
            yield t, int(two.starts[run[0]]), int(two.ends[run[-1]])


def _unmet(near: np.ndarray, one: _Block, two: _Block, tile: int, begin: int) -> None:
    """Inside a block, a tile with itself: each pair once."""
    size = one.ends[tile] - one.starts[tile]
    if one is two and begin == one.starts[tile]:
        near[:, :size] &= np.triu(np.ones((size, size), dtype=bool), 1)


def _scored(one: _Block, two: _Block, threshold: float, strict: bool):
    """(i, j, cosine) of the matches of two blocks, tile by tile; rows of ``two`` are numbered behind those of ``one``."""
    behind = 0 if one is two else one.rows
    for t, begin, end in _tile_runs(one, two, _reach(threshold)):
        first = one.starts[t]
        sims = one.vec[first : one.ends[t]] @ two.vec[begin:end].T
        near = sims >= threshold - 1e-9
        _unmet(near, one, two, t, begin)
        i, j = np.nonzero(near)
        s = np.round(sims[i, j], _DIGITS)
        ok = s > threshold if strict else s >= threshold
        if ok.any():
            yield first + i[ok], behind + begin + j[ok], s[ok]


def bucket_codes(codes: np.ndarray) -> bytes:
    """The buckets of a row, one number a table, as ``sharing_buckets`` reads them."""
    return codes.astype("uint32").tobytes()


def sharing_buckets(one: _Block, two: _Block, threshold: float, strict: bool):
    """As ``_scored``, for rows that share a bucket in any table (column ``buckets``); only those are compared."""
    held = [np.frombuffer(b"".join(x.table.column("buckets").to_pylist()), dtype="uint32").reshape(x.rows, -1) for x in (one, two)]
    narrow = "uint8" if max(h.max(initial=0) for h in held) < 256 else "uint32"
    codes, codes_2 = (np.ascontiguousarray(h.T, dtype=narrow) for h in held)
    behind = 0 if one is two else one.rows
    for t, begin, end in _tile_runs(one, two, _reach(threshold)):
        first, last = one.starts[t], one.ends[t]
        met = np.zeros((last - first, end - begin), dtype=bool)
        for x, y in zip(codes[:, first:last], codes_2[:, begin:end]):
            met |= x[:, None] == y
        _unmet(met, one, two, t, begin)
        if np.count_nonzero(met) * 8 > met.size:
            sims = one.vec[first:last] @ two.vec[begin:end].T
            i, j = np.nonzero(met & (sims >= threshold - 1e-9))
            s = np.round(sims[i, j], _DIGITS)
        else:
            i, j = np.nonzero(met)
            s = np.round(np.einsum("ij,ij->i", one.vec[first + i], two.vec[begin + j]), _DIGITS)
        ok = s > threshold if strict else s >= threshold
        if ok.any():
            yield first + i[ok], behind + begin + j[ok], s[ok]


def _near(one: _Block, two: _Block, threshold: float, strict: bool, tile: int, begin: int, end: int) -> np.ndarray:
    """Which rows of a tile and of a run match, as ``_scored`` finds them. Single precision decides all but the pairs within its error bound."""
    first = one.starts[tile]
    # of a sum of n products of unit vectors: n + 2 roundings of at most 2 ** -24 each, with some room
    error = (one.width + 8) * 2.0**-24 * 1.1
    sims = one.half[first : one.ends[tile]] @ two.half[begin:end].T
    near, open_ = sims >= np.float32(threshold + 2 * error), sims >= np.float32(threshold - 2 * error)
    if np.count_nonzero(near) != np.count_nonzero(open_):
        i, j = np.nonzero(open_ & ~near)
        s = np.round(np.einsum("ij,ij->i", one.vec[first + i], two.vec[begin + j]), _DIGITS)
        near[i, j] = s > threshold if strict else s >= threshold
    _unmet(near, one, two, tile, begin)
    return near


def _summed(parts: list[pa.Table], total: str, schema: pa.Schema) -> pa.Table:
    keys = [n for n in schema.names if n != total]
    found = pa.concat_tables(parts).group_by(keys).aggregate([(total, "sum")])
    return found.rename_columns([total if n == f"{total}_sum" else n for n in found.column_names]).select(schema.names).cast(schema)


def _grid_join(rows: DataFrame, compared, schema: str, arrow_schema: pa.Schema, threshold: float, strict: bool, total: str | None, fold=None) -> DataFrame:
    """The tables of ``compared(one, two)`` for every pair of blocks whose boxes are within reach; a ``fold`` takes their matches in task by task instead.

    Blocks are packed and gathered in a few groups; a cartesian product of the groups reads them from the checkpoint
    folder, so a row is shuffled twice whatever the number of blocks it meets.
    """
    spark = rows.sparkSession

    def pack(table: pa.Table) -> pa.Table:
        table = _tiled(_widened(table))
        return _pack(table if fold is None else fold.prepared(table, threshold, strict))

    packed = rows.groupBy("own").applyInArrow(pack, "own long, width long, raw long, low array<double>, high array<double>, data binary")
    packed = written(packed, "packed")
    # a fold reads a group's vectors one block at a time, and what leaves a task grows with the number of groups
    met = group_pairs(packed, ["own", "width", "low", "high", "data"], *((2 * _GRID_BLOCKS, 2 * _GRID_BYTES) if fold else ()))
    if met is None:
        return spark.createDataFrame([], schema)
    reach = _reach(threshold)

    def run(batches):
        for batch in batches:
            for p, q, left, right in zip(*(batch.column(c) for c in ("p", "q", "one", "two"))):
                first = [_Block.of(b) for b in left]
                others = first if p == q else [_Block.of(b) for b in right]
                found, held = [], 0
                task = None if fold is None else fold.begun(first if p == q else first + others, threshold, strict)
                for k, two in enumerate(others):
                    for one in first[: k + 1] if p == q else first:
                        if one.width != two.width or _gaps(one.low, one.high, two.low, two.high)[0, 0] > reach:
                            continue
                        if task is not None:
                            task.add(one, two)
                            continue
                        for out in compared(one, two):
                            if total is None:
                                yield from out.to_batches(max_chunksize=1 << 16)
                                continue
                            found.append(out)
                            held += out.num_rows
                            if held > _GRID_HELD:
                                found = [_summed(found, total, arrow_schema)]
                                held = 0
                    if p != q:
                        two.rest()
                for out in () if task is None else task.rows(arrow_schema):
                    yield from out.to_batches(max_chunksize=1 << 16)
                if found:
                    yield from _summed(found, total, arrow_schema).to_batches(max_chunksize=1 << 16)

    return met.mapInArrow(run, schema)


def group_pairs(packed: DataFrame, columns: list[str], most: int = _GRID_BLOCKS, size: int = _GRID_BYTES) -> DataFrame | None:
    """(p, q, one, two): every two groups of the stored ``packed`` blocks once, a group with itself included; None without blocks.

    ``packed`` has one row per block: ``own``, its unpacked size ``raw`` and the ``columns`` that a group holds of it, as structs.
    """
    spark = packed.sparkSession
    sizes = packed.select("own", "raw").orderBy("own").collect()  # one row per block
    if not sizes:
        return None
    most = max(1, min(most, size // max(r["raw"] for r in sizes)))
    cores = spark.sparkContext.defaultParallelism
    groups = min(len(sizes), max(math.ceil(len(sizes) / most), math.ceil(math.sqrt(4 * cores))))
    dealt = spark.createDataFrame([(r["own"], i % groups) for i, r in enumerate(sizes)], "own long, part int")
    spread = packed.join(F.broadcast(dealt), "own").repartitionByRange(groups, "part")  # the grouping takes this order over
    gathered = cut_lineage(spread.groupBy("part").agg(F.collect_list(F.struct(*columns)).alias("blocks")))
    one = gathered.select(F.col("part").alias("p"), F.col("blocks").alias("one"))
    two = gathered.select(F.col("part").alias("q"), F.col("blocks").alias("two"))
    # of (p, q) and (q, p) one is taken, by turns, so that no group does more than the others
    turn = ((F.col("p") + F.col("q")) % 2 == 0) == (F.col("p") < F.col("q"))
    met = one.hint("shuffle_replicate_nl").join(two, (F.col("p") == F.col("q")) | ((F.col("p") != F.col("q")) & turn))
    return met.select("p", "q", "one", "two")


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


# kernels ---------------------------------------------------------------------


def pair_kernel(table, matches):
    """All matching pairs: the one kernel whose output is the pair list itself."""
    rep, copies = table.column("rep").combine_chunks(), table.column("copies").to_numpy()
    order = pc.rank(rep, tiebreaker="dense").to_numpy().astype("int64")
    for i, j, s in _gathered(matches):
        flip = order[i] > order[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        yield {
            "rep_1": rep.take(pa.array(i)),
            "rep_2": rep.take(pa.array(j)),
            "copies_1": copies[i],
            "copies_2": copies[j],
            "similarity_score": s,
        }


def _gathered(matches):
    """Matches in portions of about ``_LIST_ROWS``."""
    waiting, total = [], 0
    for found in matches:
        waiting.append(found)
        total += len(found[0])
        if total > _LIST_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*waiting))
            waiting, total = [], 0
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


PAIR_SCHEMA = "rep_1 string, rep_2 string, copies_1 long, copies_2 long, similarity_score double"


def list_kernel(keep=(), copies: bool = True):
    """All pairs of the ids that rows hold in ``ids`` (structs of id and ``keep``), ``copies`` among themselves included.

    Pairs leave the task part by part, so neither many copies nor many matches are held at once.
    """

    def kernel(table, matches):
        held = table.column("ids").combine_chunks()
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
        starts, rows = sizes.cumsum() - sizes, held.flatten()
        ids, kept = rows.field("id"), {k: rows.field(k) for k in keep}

        def listed(a, b, score):
            a, b = pa.array(a), pa.array(b)
            one, two = ids.take(a), ids.take(b)
            swap = pc.greater(one, two)
            out = {"content_id_1": pc.if_else(swap, two, one), "content_id_2": pc.if_else(swap, one, two), "similarity_score": score}
            for k, values in kept.items():
                one, two = values.take(a), values.take(b)
                out |= {f"{k}_1": pc.if_else(swap, two, one), f"{k}_2": pc.if_else(swap, one, two)}
            return out

        waiting, total = [], 0
        for found in matches:
            for i, j, s in _portions(found, sizes):
                waiting.append(_expanded(i, j, s, sizes, starts))
                total += len(waiting[-1][0])
                if total > _LIST_ROWS:
                    yield listed(*(np.concatenate(x) for x in zip(*waiting)))
                    waiting, total = [], 0
        own = table.column("own").to_numpy()
        if copies and own.min() == own.max():
            names = ids.to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(sizes > 1):
                a, b = np.triu_indices(sizes[row], 1)
                a, b = starts[row] + a, starts[row] + b
                other = names[a] != names[b]  # a row that comes twice is no pair
                waiting.append((a[other], b[other], np.ones(other.sum())))
                total += other.sum()
                if total > _LIST_ROWS:
                    yield listed(*(np.concatenate(x) for x in zip(*waiting)))
                    waiting, total = [], 0
        if waiting:
            yield listed(*(np.concatenate(x) for x in zip(*waiting)))

    return kernel


def list_schema(keep=()) -> str:
    return ", ".join(["content_id_1 string, content_id_2 string, similarity_score double", *(f"{k}_1 string, {k}_2 string" for k in keep)])


def _portions(found, sizes: np.ndarray):
    """Matches (i, j, s) in portions that stand for about ``_LIST_ROWS`` pairs of ids, or for one match."""
    i, j, s = found
    ends = (sizes[i] * sizes[j]).cumsum()
    begin = 0
    while begin < len(i):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _LIST_ROWS, side="right"))
        end = max(end, begin + 1)
        yield i[begin:end], j[begin:end], s[begin:end]
        begin = end


def _expanded(i, j, s, sizes: np.ndarray, starts: np.ndarray):
    """Places of the ids, and the score, of every pair that the matches stand for."""
    n = sizes[i] * sizes[j]
    of = np.repeat(np.arange(len(i)), n)
    nth = np.arange(len(of)) - np.repeat(n.cumsum() - n, n)
    right = sizes[j][of]
    return starts[i][of] + nth // right, starts[j][of] + nth % right, s[of]


def degree_kernel(table, matches):
    """Neighbours of each row within this block pair; copies count as neighbours."""
    copies = table.column("copies").to_numpy()
    degree = np.zeros(table.num_rows, dtype="int64")
    for i, j, _ in matches:
        np.add.at(degree, i, copies[j])
        np.add.at(degree, j, copies[i])
    hit = np.flatnonzero(degree)
    return {"rep": table.column("rep").to_numpy(zero_copy_only=False)[hit], "degree": degree[hit]}


def _joined(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``root`` (smallest row of the connected part of each row) after the rows ``one`` and ``two`` are connected pair by pair."""
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            return root
        one, two = one[apart], two[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


CLUSTER_SCHEMA = "kind string, rep string, platform string, other string, n long"


class CountFold:
    """One pass for density clusters, and for platform counts where ``platforms`` says so; without ``min_samples`` for platform counts alone.

    Rows: ``degree`` (n neighbours of rep, copies included, at least ``min_samples`` of a core row; of a row that is a core row within its own
    block, once); ``star`` (edges that connect what core rows connect); ``edge`` (each match of a row that is not a core row
    within the task, which has fewer than ``min_samples``); ``platform`` (n rows of platform ``other`` that rep matches).

    When a block is packed, its rows are compared with each other, which finds most core rows of dense data and what connects them
    (column ``root``). A row found there costs two result rows in all; the tasks only connect the parts that
    the blocks begin with. So results grow with the rows, not with the block pairs that a row meets. Tiles whose rows are core rows of one
    part have nothing more to tell each other; where no platforms are counted, they are not compared.
    """

    def __init__(self, min_samples: int | None = None, platforms: bool = False):
        self.min_samples = min_samples
        self.platforms = platforms

    def prepared(self, table: pa.Table, threshold: float, strict: bool) -> pa.Table:
        """A block with ``root``: the first row of the part that a core row belongs to, -1 for rows that are none within the block.

        Tiles hold rows of one part, where a part fills some.
        """
        none = np.full(table.num_rows, -1, dtype="int64")
        if self.min_samples is None:
            return table
        at = _array(table, "at")
        block = _Block(0, len(table.column("vec")[0]), at.min(axis=0), at.max(axis=0), table.append_column("root", pa.array(none)))
        task = _CountTask(self.min_samples, False, [block], threshold, strict)
        task.add(block, block)
        root = np.where(task.core, task.root, -1)
        parts, back, size = np.unique(root, return_inverse=True, return_counts=True)
        table = _tiled(table.append_column("root", pa.array(root)), np.where(size[back] >= _TILE // 2, root, -1))
        # parts are named by their first row in the new order
        names, first, back = np.unique(table.column("root").to_numpy(), return_index=True, return_inverse=True)
        return _replaced(table, "root", pa.array(np.where(names[back] < 0, -1, first[back])))

    def begun(self, blocks: list[_Block], threshold: float, strict: bool) -> _CountTask:
        return _CountTask(self.min_samples, self.platforms, blocks, threshold, strict)


def cluster_kernel(min_samples: int, platforms: bool = False) -> CountFold:
    return CountFold(min_samples, platforms)


def platform_kernel() -> CountFold:
    """Per row and other platform: how many rows of that platform it matches."""
    return CountFold(None, True)


class _CountTask:
    """What a ``CountFold`` knows of the blocks of one task."""

    def __init__(self, min_samples: int | None, platforms: bool, blocks: list[_Block], threshold: float, strict: bool):
        sizes = np.array([b.rows for b in blocks])
        begins = sizes.cumsum() - sizes
        self.begin = {id(b): int(x) for b, x in zip(blocks, begins)}
        self.threshold, self.strict, self.min_samples, self.platforms = threshold, strict, min_samples, platforms
        gather = lambda name: pa.concat_arrays([b.table.column(name).combine_chunks() for b in blocks])
        rows = int(sizes.sum())
        self.rep, self.copies = gather("rep"), gather("copies").to_numpy()
        self.names, at = pa.array([], pa.string()), np.zeros(rows, dtype="int64")
        if platforms:
            coded = gather("platform").dictionary_encode()
            self.names = coded.dictionary
            at = coded.indices.fill_null(len(self.names)).to_numpy().astype("int64")
        self.at, self.kinds = at, len(self.names) + 1  # the last one: rows without a platform
        self.seen, self.counted = None, []
        if self.kinds <= _PLATFORMS:
            self.seen = np.zeros((rows, self.kinds))
            exact = "float32" if self.copies.max(initial=1) * max(sizes) < 1 << 24 else "float64"
            self.weights = np.zeros((rows, self.kinds), dtype=exact)
            self.weights[np.arange(rows), at] = self.copies
        self.degree = np.zeros(rows, dtype="int64")
        self.settled = np.zeros(rows, dtype=bool)  # a core row within its block
        self.local = np.arange(rows)
        if min_samples is not None:
            root = gather("root").to_numpy()
            self.settled = root >= 0
            self.local = np.where(self.settled, root + np.repeat(begins, sizes), self.local)
        self.root, self.core = self.local, self.settled
        self.open = [np.zeros(0, dtype="int64")] * 2
        self.parts = []

    def add(self, one: _Block, two: _Block) -> None:
        """Take in the matches of one block pair."""
        here, there = self.begin[id(one)], self.begin[id(two)]
        clusters = self.min_samples is not None
        if one is two and clusters:
            self._own(here + np.arange(one.rows))
        skip = (lambda t: self._alike(one, here, t, two, there)) if clusters and not self.platforms else None
        for t, begin, end in _tile_runs(one, two, _reach(self.threshold), skip):
            near = _near(one, two, self.threshold, self.strict, t, begin, end)
            if not near.any():
                continue
            rows, cols = slice(here + one.starts[t], here + one.ends[t]), slice(there + begin, there + end)
            self._count(near, rows, cols)
            if not clusters:
                continue
            root, root_2 = self.root[rows], self.root[cols]
            if root.min() != root.max() or root_2.min() != root_2.max() or root[0] != root_2[0]:
                # rows that are no core rows are parts of their own
                i, j = np.nonzero(near & (root[:, None] != root_2))
                self._connect(rows.start + i, cols.start + j)

    def _alike(self, one: _Block, here: int, tile: int, two: _Block, there: int) -> np.ndarray:
        """Tiles of ``two`` whose rows, like those of a tile of ``one``, are all core rows of one part."""
        rows, cols = slice(here + one.starts[tile], here + one.ends[tile]), slice(there, there + two.rows)
        root = self.root[rows]
        if not self.core[rows].all() or root.min() != root.max():
            return np.zeros(len(two.starts), dtype=bool)
        return np.logical_and.reduceat(self.core[cols] & (self.root[cols] == root[0]), two.starts)

    def _count(self, near: np.ndarray, rows: slice, cols: slice) -> None:
        if self.seen is not None:
            near = near.astype(self.weights.dtype)
            for x, y, hit in ((rows, cols, near), (cols, rows, near.T)):
                found = hit @ self.weights[y]
                self.seen[x] += found
                if self.min_samples is not None:
                    self.degree[x] += found.sum(axis=1, dtype="float64").astype("int64")
            return
        i, j = np.nonzero(near)
        i, j = rows.start + i, cols.start + j
        for x, y in ((i, j), (j, i)):
            low = x.min()
            self.degree[low : x.max() + 1] += np.bincount(x - low, self.copies[y]).astype("int64")
            cross = (self.at[x] != self.at[y]) & (self.at[x] < self.kinds - 1) & (self.at[y] < self.kinds - 1)
            key, back = np.unique(x[cross] * self.kinds + self.at[y[cross]], return_inverse=True)
            self.counted.append((key, np.bincount(back, self.copies[y[cross]], len(key)).astype("int64")))
        if sum(len(k) for k, _ in self.counted) > _GRID_HELD:
            self.counted = [self._counts()]

    def _connect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the parts of core rows that the links (i, j) connect; links of other rows stay open."""
        self.core = self.settled | (self.degree + self.copies >= self.min_samples)
        i, j = np.concatenate([self.open[0], i]), np.concatenate([self.open[1], j])
        inner = self.core[i] & self.core[j]
        if inner.any():
            self.root = _joined(self.root, i[inner], j[inner])
        self.open = [i[~inner], j[~inner]]

    def _own(self, at: np.ndarray) -> None:
        """What a block's core rows say for themselves, once in all."""
        rows = at[self.settled[at]]
        self.parts.append(("degree", rows, None, None, np.full(len(rows), self.min_samples)))
        rows = rows[self.local[rows] != rows]
        self.parts.append(("star", self.local[rows], None, rows, None))

    def _counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(row * kinds + other platform, n)."""
        if self.seen is not None:
            cross = self.seen > 0
            cross[np.arange(len(self.at)), self.at] = False
            cross[:, -1] = False
            cross[self.at == self.kinds - 1] = False
            return np.flatnonzero(cross), self.seen[cross].astype("int64")
        keys, n = (np.concatenate(x) for x in zip(*self.counted)) if self.counted else (np.zeros(0, dtype="int64"),) * 2
        keys, back = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), dtype="int64")
        np.add.at(total, back, n)
        return keys, total

    def rows(self, schema: pa.Schema):
        """The result rows; a schema without ``kind`` takes the platform counts alone."""
        parts = []
        if self.min_samples is not None:
            first = self.local == np.arange(len(self.local))
            moved = np.flatnonzero(self.core & first & (self.root != self.local))
            counts = np.flatnonzero(~self.settled & (self.degree > 0))
            one, two = self.open
            parts = [
                *self.parts,
                ("degree", counts, None, None, self.degree[counts]),
                ("star", self.root[moved], None, moved, None),
                ("edge", one, None, two, None),
            ]
        for kind, rows, _, other, n in parts:
            yield self._table(schema, kind, rows, None, None if other is None else self.rep.take(pa.array(other)), n)
        if self.platforms:
            key, n = self._counts()
            row, other = key // self.kinds, key % self.kinds
            for i in range(0, len(row), _LIST_ROWS):
                part = slice(i, i + _LIST_ROWS)
                names = [self.names.take(pa.array(x)) for x in (self.at[row[part]], other[part])]
                yield self._table(schema, "platform", row[part], *names, n[part])

    def _table(self, schema: pa.Schema, kind: str, rows: np.ndarray, platform, other, n) -> pa.Table:
        values = [self.rep.take(pa.array(rows)), platform, other, n]
        if "kind" in schema.names:
            values = [pa.repeat(pa.scalar(kind), len(rows)), *values]
        columns = [pa.nulls(len(rows), f.type) if x is None else pa.array(x, type=f.type) for x, f in zip(values, schema)]
        return pa.Table.from_arrays(columns, schema=schema)


def scope_count_kernel(table, matches):
    """Number of matching pairs per scope value, copies multiplied out."""
    scope = table.column("scope").to_numpy()
    copies = table.column("copies").to_numpy()
    values, at = np.unique(scope, return_inverse=True)
    pairs = np.zeros(len(values), dtype="int64")
    for i, j, _ in matches:
        np.add.at(pairs, at[i], copies[i] * copies[j])
    hit = np.flatnonzero(pairs)
    return {"scope": values[hit], "pairs": pairs[hit]}

