"""Counts of word-overlap pairs (A11 over J4): word sets are compared block by block, no candidate pair leaves a task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor import config
from candor.operators import blocks
from candor.session import written

_SKETCH = 256  # buckets of the word counts that sets are placed by
_WORDS = 4096  # columns of a dense product
_HITS = 1 << 22  # shared words, ids or counts that are spread out at once
_DENSE = 256  # a word in more than one in _DENSE pairs of a block pair is counted by a dense product
_CODE = 1 << 32  # (size, shared words) as one number


def hash_seed(sets: DataFrame) -> int:
    """The first seed whose 64-bit hash keeps all words of the sets (column ``tokens``) apart, so hashes stand for words exactly."""
    words = sets.select(F.explode("tokens").alias("token")).distinct()
    seed = 0
    while words.groupBy(F.xxhash64(F.lit(seed), "token")).count().where("count > 1").limit(1).count():
        seed += 1
    return seed


def _sketches(tokens: pa.Array) -> np.ndarray:
    """Share of a set's words by bucket of their hash."""
    size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    row = np.repeat(np.arange(len(tokens)), size)
    found = np.bincount(row * _SKETCH + (tokens.flatten().to_numpy() & (_SKETCH - 1)), minlength=len(tokens) * _SKETCH)
    return found.reshape(-1, _SKETCH) / np.maximum(size, 1)[:, None]


def placed(sets: DataFrame, block_rows: int) -> DataFrame:
    """Give every stored set (key, tokens as hashes, ids) its block ``own``: sets of similar words share cells. Results do not depend on it."""
    n = sets.count()

    @F.arrow_udf("array<double>")
    def sketch(tokens: pa.Array) -> pa.Array:
        ends = pa.array(np.arange(len(tokens) + 1, dtype="int32") * _SKETCH)
        return pa.ListArray.from_arrays(ends, pa.array(_sketches(tokens).ravel()))

    chosen = sets.orderBy(F.xxhash64("key"), "key").limit(min(config.MAX_PIVOTS, max(n, 1)))
    sample = np.array([r[0] for r in chosen.select(sketch("tokens")).collect()]).reshape(-1, _SKETCH)
    centre = sample.mean(axis=0) if len(sample) else np.zeros(_SKETCH)
    axes = np.linalg.svd(sample - centre, full_matrices=False)[2][:8].T if len(sample) else np.zeros((_SKETCH, 1))
    cells = max(1, min(config.MAX_PIVOTS // 2, math.ceil(n / block_rows)))
    nodes, leaves = blocks._split((sample - centre) @ axes, max(1, math.ceil(len(sample) / cells)))

    @F.arrow_udf("int")
    def cell(tokens: pa.Array) -> pa.Array:
        at = (_sketches(tokens) - centre) @ axes
        return pa.array(blocks._leaf_of(at, nodes).astype("int32"))

    celled = sets.withColumn("cell", cell("tokens"))
    split = np.ones(len(leaves), dtype="int64")
    for r in celled.groupBy("cell").count().collect():
        split[r[0]] = -(-r[1] // block_rows)
    parts = F.element_at(F.array(*[F.lit(int(b)) for b in split]), F.col("cell") + 1)
    own = F.col("cell").cast("long") * F.lit(blocks._BLOCKS) + F.pmod(F.xxhash64("key", F.get("ids", 0)), parts)
    return celled.withColumn("own", own).select("own", "tokens", "ids")


def _pack(table: pa.Table) -> pa.Table:
    """All sets of one block as one row: the hashes of its words and the sets as places in them, as compressed Arrow streams."""
    tokens = table.column("tokens").combine_chunks()
    words, codes = np.unique(tokens.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    sets = pa.table({"size": tokens.value_lengths(), "ids": table.column("ids").combine_chunks()})
    flat = [pa.table({"v": words}), pa.table({"v": codes.astype("uint32")})]
    data = []
    for part in (sets, *flat):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(part)
        data.append(sink.getvalue().to_pybytes())
    raw = sets.nbytes + sum(t.nbytes for t in flat)
    return pa.table({
        "own": pa.array([table.column("own")[0].as_py()], pa.int64()),
        "raw": pa.array([raw], pa.int64()),
        **{name: pa.array([d], pa.binary()) for name, d in zip(("sets", "words", "codes"), data)},
    })


class _Block:
    """The sets of an unpacked block; ids become places in the order of all ids of the task."""

    def __init__(self, packed):
        read = lambda name: pa.ipc.open_stream(packed[name].as_buffer()).read_all().combine_chunks()
        sets = read("sets")
        self.words, self.code = (read(name).column("v").to_numpy() for name in ("words", "codes"))
        self.size = sets.column("size").to_numpy().astype("int64")
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        ids = sets.column("ids").combine_chunks()
        self.n, self.names = ids.value_lengths().to_numpy().astype("int64"), ids.flatten()
        self.starts = self.n.cumsum() - self.n

    def rank(self, order: np.ndarray, ratio: float) -> None:
        of = np.repeat(np.arange(len(self.n)), self.n)
        self.ids = order[np.lexsort((order, of))]
        self.low, self.high = self.ids[self.starts], self.ids[self.starts + self.n - 1]
        self.flat = of * _CODE + self.ids
        self.need = _needed(self.size, ratio)


def _needed(size: np.ndarray, ratio: float) -> np.ndarray:
    """The fewest shared words whose share of ``size`` is above ``ratio``, as doubles are divided."""
    need = np.maximum(np.floor(size * ratio).astype("int64") - 1, 1)
    while (short := need / size <= ratio).any():
        need = need + short
    return need


def _shared(one: tuple, two: tuple, n: int, n_2: int, words: int) -> np.ndarray:
    """Number of words that each of ``n`` sets shares with each of ``n_2`` others, from (set, word) of either side."""
    out = np.zeros((n, n_2), dtype="float32")
    d, d_2 = (np.bincount(w, minlength=words) for _, w in (one, two))
    hits = d * d_2
    often = hits >= max(2, n * n_2 // _DENSE)
    place = np.cumsum(often) - 1
    total = int(often.sum())
    sides = [(r[often[w]], place[w[often[w]]]) for r, w in (one, two)]
    for low in range(0, total, _WORDS):
        width = min(_WORDS, total - low)
        parts = []
        for (r, c), rows in zip(sides, (n, n_2)):
            here = (c >= low) & (c < low + width) if total > _WORDS else slice(None)
            parts.append(np.zeros((rows, width), dtype="float32"))
            parts[-1][r[here], c[here] - low] = 1
        out += parts[0] @ parts[1].T
    rare = (hits > 0) & ~often
    (r, w), (r_2, w_2) = ((r[rare[w]], w[rare[w]]) for r, w in (one, two))
    order = np.argsort(w_2, kind="stable")
    r_2, starts = r_2[order], np.cumsum(np.where(rare, d_2, 0)) - d_2
    times = d_2[w]
    for part in _parts(times):
        t = times[part]
        at = np.repeat(starts[w[part]] - (t.cumsum() - t), t) + np.arange(t.sum())
        flat = np.repeat(r[part], t) * n_2 + r_2[at]
        if len(flat) < out.size // 16:
            flat, found = np.unique(flat, return_counts=True)
            out.reshape(-1)[flat] += found
        else:
            out += np.bincount(flat, minlength=out.size).reshape(out.shape)
    return out


def _parts(times: np.ndarray):
    """Slices of rows that stand for about ``_HITS`` entries each."""
    ends, begin = times.cumsum(), 0
    while begin < len(times):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _HITS, side="right")))
        yield slice(begin, end)
        begin = end


def _ordered_ids(first: _Block, i: np.ndarray, second: _Block, j: np.ndarray) -> np.ndarray:
    """For each pair of sets (i, j): in how many pairs an id of i is below one of j."""
    n = first.n[i] * second.n[j]
    n[first.low[i] >= second.high[j]] = 0
    mixed = np.flatnonzero((first.high[i] >= second.low[j]) & (n > 0))
    n[mixed] = 0
    # each id of the smaller set is ranked in the larger one
    fewer = first.n[i[mixed]] <= second.n[j[mixed]]
    for at, few, x, many, y, above in ((mixed[fewer], first, i, second, j, True), (mixed[~fewer], second, j, first, i, False)):
        for part in _parts(few.n[x[at]]):
            rows = at[part]
            size = few.n[x[rows]]
            of = np.repeat(np.arange(len(rows)), size)
            ids = few.ids[np.repeat(few.starts[x[rows]] - (size.cumsum() - size), size) + np.arange(size.sum())]
            other = y[rows][of]
            rank = np.searchsorted(many.flat, other * _CODE + ids, side="right" if above else "left") - many.starts[other]
            n[rows] = np.bincount(of, many.n[other] - rank if above else rank, len(rows)).astype("int64")
    return n


def _counted(first: _Block, i: np.ndarray, second: _Block, j: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of size and shared words, n) of pairs of sets with an id of i below one of j; parts of one set are no pair."""
    other = (shared != first.size[i]) | (shared != second.size[j])
    i, j, shared = i[other], j[other], shared[other]
    n = _ordered_ids(first, i, second, j)
    sizes, at = np.unique(first.size, return_inverse=True)
    width = int(shared.max(initial=0)) + 1
    if len(sizes) * width > _HITS:
        codes, back = np.unique(first.size[i] * _CODE + shared, return_inverse=True)
        return codes, np.bincount(back, n, len(codes)).astype("int64")
    found = np.bincount(at[i] * width + shared, n, len(sizes) * width).astype("int64")
    hit = np.flatnonzero(found)
    return sizes[hit // width] * _CODE + hit % width, found[hit]


def _compared(one: _Block, two: _Block):
    """``_counted`` of all pairs of sets of two blocks, or of one block with itself, in both orders."""
    same = one is two
    if same:
        place = np.where(np.bincount(one.code, minlength=len(one.words)) > 1, np.arange(len(one.words)), -1)
        sides, words = [(one, place[one.code])] * 2, len(place)
    else:
        at = np.minimum(np.searchsorted(two.words, one.words), max(len(two.words) - 1, 0))
        met = two.words[at] == one.words
        words = int(met.sum())
        place, place_2 = np.where(met, np.cumsum(met) - 1, -1), np.full(len(two.words), -1)
        place_2[at[met]] = np.arange(words)
        sides = [(one, place[one.code]), (two, place_2[two.code])]
    known = [(b.row[c >= 0], c[c >= 0]) for b, c in sides]
    # words a set shares with the other block at all: too few, and it cannot be the first of a pair
    near, near_2 = (np.bincount(r, minlength=len(b.size)) for (r, _), b in zip(known, (one, two)))
    lead, lead_2 = near >= one.need, near_2 >= two.need
    least = lambda need: need.min(initial=np.iinfo("int64").max)
    follows = near_2 >= least(one.need[lead])
    tasks = [(lead, follows if same else follows | lead_2, True)]
    if not same:
        tasks.append((~lead & (near >= least(two.need[lead_2])), lead_2, False))
    for rows, cols, forward in tasks:
        a, b = np.flatnonzero(rows), np.flatnonzero(cols)
        if not len(a) or not len(b):
            continue
        cut = []
        for (r, c), kept in zip(known, (rows, cols)):
            here, to = kept[r], np.cumsum(kept) - 1
            cut.append((to[r[here]], c[here]))
        shared = _shared(*cut, len(a), len(b), words)
        if forward:
            hit = (shared >= one.need[a][:, None]) & (one.low[a][:, None] < two.high[b])
            if same:
                hit &= a[:, None] != b
            x, y = np.nonzero(hit)
            yield _counted(one, a[x], two, b[y], shared[x, y].astype("int64"))
        if not same:
            x, y = np.nonzero((shared >= two.need[b]) & (two.low[b] < one.high[a][:, None]))
            yield _counted(two, b[y], one, a[x], shared[x, y].astype("int64"))


def _added(parts: list) -> list:
    codes, n = (np.concatenate(x) for x in zip(*parts))
    codes, back = np.unique(codes, return_inverse=True)
    total = np.zeros(len(codes), dtype="int64")
    np.add.at(total, back, n)
    return [(codes, total)]


def pair_counts(sets: DataFrame, min_ratio: float, block_rows: int = config.PAIR_BLOCK_ROWS) -> DataFrame:
    """(word_overlap_ratio, n): pairs of ids id_1 < id_2 of different sets by |A and B| / |A|, above ``min_ratio``; a ratio may come several times.

    ``sets`` (key, tokens, ids) is stored; tokens are hashes that keep words apart, and a set of many ids may come in parts. Blocks of sets are packed,
    a cartesian product of their groups reads them from the checkpoint folder, and tasks count the shared words of their sets: common words by
    products of matrices, others by their places. Only counts leave the tasks. The number of compared pairs stays quadratic.
    """
    packed = placed(sets, block_rows).groupBy("own").applyInArrow(_pack, "own long, raw long, sets binary, words binary, codes binary")
    schema = "word_overlap_ratio double, n long"
    met = blocks.group_pairs(written(packed, "packed-sets"), ["sets", "words", "codes"])
    if met is None:
        return sets.sparkSession.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for p, q, left, right in zip(*(batch.column(c) for c in ("p", "q", "one", "two"))):
                first = [_Block(b) for b in left]
                others = first if p == q else [_Block(b) for b in right]
                every = first if p == q else first + others
                order = pc.rank(pa.chunked_array([b.names for b in every]).combine_chunks(), tiebreaker="dense").to_numpy().astype("int64")
                ends = np.cumsum([len(b.names) for b in every])
                for b, end in zip(every, ends):
                    b.rank(order[end - len(b.names) : end], min_ratio)
                found, held = [], 0
                for k, one in enumerate(first):
                    for two in others[k:] if p == q else others:
                        for part in _compared(one, two):
                            found.append(part)
                            held += len(part[0])
                            if held > blocks._GRID_HELD:
                                found = _added(found)
                                held = 0
                for codes, n in _added(found) if found else ():
                    rows = pd.DataFrame({"word_overlap_ratio": (codes % _CODE) / (codes // _CODE), "n": n})
                    yield from pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=1 << 16)

    return met.mapInArrow(run, schema)
