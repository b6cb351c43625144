"""Nearest neighbours by a permutation index (operator 3).

A vector is represented by its nearest pivots in order. The index holds this
order for every row. Rows are dealt into segments by their ids when the index is written, so answers do
not depend on how the input was cut. Every segment of the index posts its rows in inverted files,
one per pivot, with the pivot's place in the row's order. A query reads the files
of its own nearest pivots, which adds up the footrule distance between its order
and that of each row; the share of each segment that ranks first is reranked by
the exact distance on the original vectors.

Queries are taken in passes of bounded size: each pass broadcasts its queries and
reads the index once, without moving a vector, and every task hands on only the
best ``k`` rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.vectors import by_length, usable
from candor.session import written

PIVOTS = 1024  # vectors sampled as pivots, the bound of the fitted part
POSTED = 64  # pivots of a row's order
PROBED = 64  # pivots of a query's order
SHARE = 0.4  # of a segment that is reranked
LEAST = 32  # rows of a segment that are reranked at least
SEGMENT = 4096  # rows of a segment, about
PASS_BYTES = 8 << 20  # of the queries of one pass


def pivot_orders(x: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the ``most`` nearest pivots of every row, nearest first."""
    most = min(most, len(pivots))
    found = np.empty((len(x), most), np.int16)
    square = (pivots**2).sum(1)
    for i in range(0, len(x), 1024):
        far = square - 2 * x[i : i + 1024] @ pivots.T
        found[i : i + 1024] = np.argsort(far, axis=1, kind="stable")[:, :most]
    return found


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` distinct vectors of the commonest length, those with the smallest hashes."""
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return np.zeros((0, 0))
    same = rows.where(F.size("vector") == length["n"]).select("vector", F.xxhash64("vector").alias("hash"))
    drawn = same.select("hash").distinct().orderBy("hash").limit(pivots)
    taken = same.join(F.broadcast(drawn), "hash", "left_semi").groupBy("hash").agg(F.min("vector").alias("vector"))
    return np.array([r["vector"] for r in taken.orderBy("hash").collect()], float)


def build_index(df: DataFrame, pivots: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """One row per segment: (ids, vectors, orders) of its rows in id order, as bytes, with their number and length.

    A segment holds about ``segment`` rows of one vector length, chosen by a hash of id and vector. Rows of another length
    than the pivots have an empty order.
    """
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    sizes = df.groupBy(F.size("vector").alias("width")).agg(F.greatest(F.lit(1), F.round(F.count("*") / segment)).cast("int").alias("segments"))
    placed = df.select("id", "vector", F.size("vector").alias("width")).join(F.broadcast(sizes), "width")

    def pack(table: pa.Table) -> pa.Table:
        x = by_length(table.column("vector"))[0][1]
        ids = table.column("id").to_numpy()
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        same = len(shared.value) and x.shape[1] == shared.value.shape[1]
        orders = pivot_orders(x, shared.value, POSTED) if same else np.zeros((len(x), 0), np.int16)
        columns = [[len(ids)], [x.shape[1]], [ids.astype(np.int64).tobytes()], [x.tobytes()], [np.ascontiguousarray(orders).tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n", "width", "ids", "vectors", "ord"])

    spread = F.pmod(F.xxhash64("id", "vector"), F.col("segments")).alias("segment")
    return placed.select("id", "vector", "width", spread).groupBy("width", "segment").applyInArrow(
        pack, "n long, width long, ids binary, vectors binary, ord binary"
    )


class Segment:
    """Inverted files of some rows of one vector length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, orders: np.ndarray, pivots: int):
        self.ids, self.x = ids, x
        n, self.posted = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row = (by_pivot // max(self.posted, 1)).astype(np.int32)
        self.place = (by_pivot % max(self.posted, 1)).astype(np.int32)
        self.file = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.most = n if not self.posted else min(n, max(LEAST, int(np.ceil(SHARE * n))))

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """Rows with the smallest footrule distance to the query's order; ties by row."""
        if self.most >= len(self.ids):
            return np.arange(len(self.ids))
        probed, scale = len(order), len(order) / self.posted
        files = [slice(self.file[p], self.file[p + 1]) for p in order]
        spot = np.repeat(np.arange(probed), [f.stop - f.start for f in files])
        row = np.concatenate([self.row[f] for f in files])
        place = np.concatenate([self.place[f] for f in files])
        # what a shared pivot takes off the distance of an order that shares none
        nearer = (probed - spot) - np.abs(place * scale - spot)
        total = np.bincount(row, weights=nearer, minlength=len(self.ids))
        return np.argsort(-total, kind="stable")[: self.most]

    def nearest(self, own: int, x: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the best ``k`` candidates, the query's own id left out."""
        rows = self.candidates(order)
        rows = rows[self.ids[rows] != own]
        far = np.sqrt(((self.x[rows] - x) ** 2).sum(1))
        best = np.lexsort((self.ids[rows], far))[:k]
        return far[best], self.ids[rows][best]


def search(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for every query row (id, vector)."""
    spark = index.sparkSession
    queries = written(queries, "nearest-queries")
    width = queries.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    per_pass = max(1, PASS_BYTES // (8 * width + 2 * PROBED + 8))
    total = queries.count()
    passes = -(-total // per_pass)
    part = F.pmod(F.xxhash64("id"), F.lit(passes))
    found = None
    for i in range(passes):
        rows = queries.where(part == i).orderBy("id").collect()
        asked = []
        for r in rows:
            x = np.array(r["vector"], float)
            same = len(pivots) and len(x) == pivots.shape[1]
            asked.append((r["id"], x, pivot_orders(x[None], pivots, PROBED)[0] if same else np.zeros(0, np.int16)))
        now = _one_pass(index, spark.sparkContext.broadcast(asked), len(pivots), k)
        if passes > 1:
            now = written(now, "nearest-pass")
        found = now if found is None else found.unionByName(now)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _one_pass(index: DataFrame, asked, pivots: int, k: int) -> DataFrame:
    def task(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n_rows, width, ids, raw, ord_ in zip(*(batch.column(i).to_pylist() for i in range(5))):
                x = np.frombuffer(raw, np.float64).reshape(n_rows, width)
                own = np.frombuffer(ord_, np.int16).reshape(n_rows, -1)
                segment = Segment(np.frombuffer(ids, np.int64), x, own, pivots)
                for n, (query, v, order) in enumerate(asked.value):
                    if len(v) == width:
                        far, near = segment.nearest(query, v, order, k)
                        if n in best:
                            far, near = np.r_[best[n][0], far], np.r_[best[n][1], near]
                            keep = np.lexsort((near, far))[:k]
                            far, near = far[keep], near[keep]
                        best[n] = far, near
        if best:
            who = np.repeat([asked.value[n][0] for n in best], [len(b[0]) for b in best.values()])
            far, near = (np.concatenate([b[c] for b in best.values()]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(who, pa.int64()), pa.array(near, pa.int64()), pa.array(far, pa.float64())],
                names=["query_id", "vec_id", "score"],
            )

    return index.select("n", "width", "ids", "vectors", "ord").mapInArrow(task, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` nearest rows found of every row for which ``is_query`` (a condition) holds.

    Vectors that are null, zero or hold null or non-finite components and rows
    with a null id take no part; vectors meet those of equal length. A query that
    stands in several rows is asked once, with its smallest vector; repeated rows
    are a candidate each. Ties go to the smaller id. An empty table gives no rows.
    """
    rows = df.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("_asked")
    )
    chosen = choose_pivots(rows, pivots)
    # of rows equal in id and vector more than k cannot be among the k nearest, so a hot one stays small
    single = rows.groupBy("id", "vector").agg(F.count("*").alias("copies")).select(
        "id", "vector", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k + 1).cast("long")))).alias("copy")
    )
    index = written(build_index(single, chosen), "permutation-index")
    queries = rows.where("_asked").groupBy("id").agg(F.min("vector").alias("vector"))
    return search(index, queries, chosen, k)
