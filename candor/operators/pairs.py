"""Similar pairs (J1-J3) and similarity search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor import config
from candor.operators import blocks
from candor.operators.skew import balanced_join, lookup
from candor.session import cut_lineage, written


def similar_groups(
    df: DataFrame,
    id: str = "content_id",
    vector: str = "embedding",
    threshold: float = config.SIMILARITY_THRESHOLD,
    strict: bool = False,
    scope: str | None = None,
    block_rows: int = config.PAIR_BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The similar pairs of ``df``, factorised by identical vectors.

    Vectors of different lengths do not qualify as a pair.
    Returns ``(members, pairs)``: ``members`` maps every id to its representative
    ``rep`` (the smallest id with the same vector), ``pairs`` holds the pairs of
    representatives with their copy counts. Together they stand for every pair;
    a vector shared by a third of all rows is one row of ``pairs``.
    """
    keep = [scope] if scope else []
    found = written(blocks.unit_members(df, id, vector, keep), "vectors")
    reps = written(blocks.representatives(found, scope), "distinct")
    placed = blocks.place(reps, threshold, block_rows=block_rows)
    pairs = blocks.blocked_join(placed, blocks.pair_kernel, blocks.PAIR_SCHEMA, threshold, strict, scope)
    keys = ["vkey", *keep]
    table = reps.select("rep", "copies", F.col("copies").alias("weight"), *keys)
    return lookup(found.select("id", *keys), table, keys, "weight").drop(*keys), pairs


def similar_pairs(
    df: DataFrame,
    id: str = "content_id",
    vector: str = "embedding",
    threshold: float = config.SIMILARITY_THRESHOLD,
    strict: bool = False,
    scope: str | None = None,
    similarity_type: str = "semantic",
    block_rows: int = config.PAIR_BLOCK_ROWS,
    keep=(),
) -> DataFrame:
    """Unordered pairs with cosine at or above the threshold, one row per pair of ids.

    The rows are the reported result, so their number is the operator's output
    size; detection itself never goes through this list. The ids travel with the vectors, so the tasks
    that compare them list the pairs, and no pair is shuffled; the list is written once. String columns in ``keep`` come out with the suffix of their id.
    """
    carried = [k for k in keep if k != scope]
    found = cut_lineage(blocks.unit_members(df, id, vector, [*([scope] if scope else []), *carried]))
    placed = blocks.place(cut_lineage(blocks.id_chunks(found, scope, keep)), threshold, block_rows=block_rows)
    kernel = blocks.list_kernel(keep, copies=not (strict and threshold >= 1.0))
    listed = blocks.blocked_join(placed, kernel, blocks.list_schema(keep), threshold, strict, scope, carry=["ids"])
    return written(listed, "pairs").withColumn("similarity_type", F.lit(similarity_type))


def expand_pairs(members: DataFrame, pairs: DataFrame, threshold: float, strict: bool = False, chunk: int = 1000) -> DataFrame:
    """Pairs of representatives -> pairs of ids.

    The copies of a representative travel as hashed chunks of about ``chunk``
    ids, so a hot group of copies spreads over as many rows as it has chunks.
    """
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / chunk))
    chunks = members.groupBy("rep", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    one = chunks.select(F.col("rep").alias("rep_1"), F.col("ids").alias("ids_1"))
    two = chunks.select(F.col("rep").alias("rep_2"), F.col("ids").alias("ids_2"))
    across = (
        balanced_join(cut_lineage(balanced_join(cut_lineage(pairs), one, ["rep_1"])), two, ["rep_2"])
        .select("similarity_score", F.explode("ids_1").alias("a"), "ids_2")
        .select("similarity_score", "a", F.explode("ids_2").alias("b"))
    )
    out = across
    if not (strict and threshold >= 1.0):
        copied = balanced_join(cut_lineage(members.where("copies > 1").select("rep", F.col("id").alias("a"))), chunks, ["rep"])
        within = copied.select(F.lit(1.0).alias("similarity_score"), "a", F.explode("ids").alias("b")).where("a < b")
        out = across.unionByName(within)
    return out.select(
        F.least("a", "b").alias("content_id_1"), F.greatest("a", "b").alias("content_id_2"), "similarity_score"
    )


def lsh_pairs(
    df: DataFrame,
    id: str = "content_id",
    vector: str = "embedding",
    threshold: float = config.SIMILARITY_THRESHOLD,
    bits: int = 8,
    recall: float = 0.95,
    seed: int = 1,
    block_rows: int = config.PAIR_BLOCK_ROWS,
) -> DataFrame:
    """Approximate J1: rows that share a bucket are compared exactly, copies included.

    A bucket is the signs of ``bits`` random projections, so it holds about
    2 ** -bits of unrelated rows. The number of tables follows from the threshold:
    a pair right at it shares a bucket with probability ``recall``, closer ones
    more often. A subset of the exact pairs. Vectors are not shuffled once per table: they lie in packed blocks with their
    bucket numbers, tasks look for shared buckets block by block, and a pair that shares several is met once.
    """
    members = written(blocks.unit_members(df, id, vector), "vectors")
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    tables = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-min(same, 1 - 1e-9)))))

    @F.pandas_udf("binary")
    def buckets(vec: pd.Series) -> pd.Series:
        out = []
        for v in vec:
            planes = np.random.default_rng([seed, len(v)]).normal(size=(len(v), tables * bits)) if not out or len(v) != len(planes) else planes
            signs = (np.asarray(v) @ planes > 0).reshape(tables, bits)
            out.append(blocks.bucket_codes(signs @ (1 << np.arange(bits))))
        return pd.Series(out)

    placed = blocks.place(written(blocks.id_chunks(members), "distinct"), threshold, block_rows=block_rows)
    rows = placed.withColumn("buckets", buckets("vec"))
    found = blocks.blocked_join(
        rows, blocks.list_kernel(), blocks.list_schema(), threshold, carry=["ids", "buckets"], scored=blocks.sharing_buckets
    )
    return written(found, "pairs")


def sql_similar_pairs(df: DataFrame, threshold: float = config.SIMILARITY_THRESHOLD) -> DataFrame:
    """Pairs of one content type with cosine strictly above the threshold."""
    return similar_pairs(df, threshold=threshold, strict=True, scope="content_type")


def equal_similarity_campaigns(
    pairs: DataFrame, min_size: int = config.CAMPAIGN_MIN_SIZE, digits: int | None = None
) -> DataFrame:
    """Group the ids of all pairs by their similarity value.

    Returns members (similarity, content_id) of the groups with at least
    ``min_size`` distinct ids, with size and mean similarity. ``digits`` rounds
    the value first, since doubles rarely repeat exactly.
    """
    value = F.col("similarity_score") if digits is None else F.round("similarity_score", digits)
    ends = pairs.select(F.explode(F.array("content_id_1", "content_id_2")).alias("content_id"), value.alias("similarity"), "similarity_score")
    rows = ends.groupBy("similarity", "content_id").agg(
        F.sum("similarity_score").alias("s"), F.count("*").alias("n")
    )
    sizes = (
        rows.groupBy("similarity")
        .agg(F.count("*").alias("campaign_size"), (F.sum("s") / F.sum("n")).alias("avg_similarity"))
        .where(F.col("campaign_size") >= min_size)
    )
    sizes = sizes.withColumn("weight", F.col("campaign_size"))
    return lookup(rows.select("similarity", "content_id"), sizes, ["similarity"], "weight")


def equal_similarity_groups(
    members: DataFrame, pairs: DataFrame, min_size: int = config.CAMPAIGN_MIN_SIZE, digits: int | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """J3 from the factorised pairs of ``similar_groups``: ``(groups, members)``, the latter with one row per value and id.

    A pair of representatives stands for copies_1 * copies_2 pairs of one value, copies of a vector are pairs of value 1 among
    themselves; sizes and means follow from these weights. No pair of ids is listed.
    """
    value = F.col("s") if digits is None else F.round("s", digits)
    weighed = pairs.select(
        F.col("similarity_score").alias("s"), (F.col("copies_1") * F.col("copies_2")).alias("n"),
        F.array(F.struct(F.col("rep_1").alias("rep"), F.col("copies_1").alias("copies")), F.struct(F.col("rep_2").alias("rep"), F.col("copies_2").alias("copies"))).alias("ends"),
    )
    if not strict:
        copied = members.where("id = rep and copies > 1").select(
            F.lit(1.0).alias("s"), F.expr("copies * (copies - 1) div 2").alias("n"), F.array(F.struct("rep", "copies")).alias("ends"))
        weighed = weighed.unionByName(copied)
    # a pair counts at both of its ends, so figures per value come from the ends alone; the pairs are read once and not stored
    half, sn, n = F.when(F.size("ends") == 2, 1).otherwise(2), F.col("s") * F.col("n"), F.col("n")
    ends = weighed.select(value.alias("similarity"), F.explode("ends").alias("e"), (sn * half).alias("s"), (n * half).alias("n"))
    ends = cut_lineage(ends.groupBy("similarity", "e.rep", "e.copies").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    mean = (F.sum("s") / F.sum("n")).alias("avg_similarity")
    groups = ends.groupBy("similarity").agg(F.sum("copies").alias("campaign_size"), F.count("*").alias("weight"), mean)
    groups = cut_lineage(groups.where(F.col("campaign_size") >= min_size))
    held = lookup(ends, groups.select("similarity", "weight"), ["similarity"], "weight")
    ids = members.select(F.col("id").alias("content_id"), "rep")
    return groups.drop("weight"), balanced_join(cut_lineage(held.select("similarity", "rep")), ids, ["rep"]).select("similarity", "content_id")


def suspicious_ids(pairs: DataFrame) -> DataFrame:
    """Distinct ids on either side of a listed pair."""
    return pairs.select(F.explode(F.array("content_id_1", "content_id_2")).alias("content_id")).distinct()


def similar_ids(
    df: DataFrame, id: str = "content_id", vector: str = "embedding", threshold: float = config.SIMILARITY_THRESHOLD, block_rows: int = config.BLOCK_ROWS
) -> DataFrame:
    """The ids that any pair of J1 would hold (A14): those with a copy, or with a neighbour in any block. No pair leaves a block."""
    found = cut_lineage(blocks.unit_members(df, id, vector))
    reps = cut_lineage(blocks.representatives(found))
    placed = blocks.place(reps, threshold, block_rows=block_rows)
    near = blocks.blocked_join(placed, blocks.degree_kernel, "rep string, degree long", threshold, total="degree").select("rep").distinct()
    paired = reps.join(near.withColumn("paired", F.lit(True)), "rep", "left").where("paired or copies > 1").select("vkey", "copies")
    return lookup(found.select(F.col("id").alias("content_id"), "vkey"), cut_lineage(paired), ["vkey"], "copies").select("content_id").distinct()


def _passes(queries: DataFrame):
    """Ids and unit vectors of the queries in parts of about PASS_QUERIES rows, each in a broadcast.

    Any number of queries works; only the number of passes over the candidates grows.
    """
    total = queries.count()
    passes = -(-total // config.PASS_QUERIES)
    rows = queries.select(F.col("query_id").cast("string").alias("id"), F.col("query").cast("array<double>").alias("query"))
    for i in range(passes):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).orderBy("id").collect()
        by_length: dict[int, list] = {}
        for r in part:
            by_length.setdefault(len(r["query"] or ()), []).append(r)
        yield [(np.array([r["id"] for r in rs], dtype=object), _unit([r["query"] or () for r in rs])) for rs in by_length.values()]


def _cosines(batch: pd.DataFrame, unit: np.ndarray) -> np.ndarray:
    """Cosine of every row of the batch to every query; 0 for unequal lengths and zero vectors."""
    out = np.zeros((len(batch), len(unit)))
    fits = np.array([v is not None and len(v) == unit.shape[1] for v in batch["embedding"]], dtype=bool)
    if fits.any():
        v = np.stack(batch["embedding"].to_numpy()[fits]).astype("float64")
        sizes = np.linalg.norm(v, axis=1, keepdims=True)
        out[fits] = np.round(np.divide(v, sizes, out=np.zeros_like(v), where=sizes > 0) @ unit.T, 12)
    return out


def _unit(vectors) -> np.ndarray:
    q = np.array(vectors, dtype="float64")
    sizes = np.linalg.norm(q, axis=1, keepdims=True)
    return np.divide(q, sizes, out=np.zeros_like(q), where=sizes > 0)


def _search(queries: DataFrame, candidates: DataFrame, task, schema: str, block: int) -> DataFrame:
    """Stream the candidates past the query vectors; ``task`` sees one partition and ``block`` queries at a time.

    Beyond one pass the candidates are written once, so their embedding is not computed again.
    """
    rows = candidates.select(F.col("content_id").cast("string").alias("content_id"), "embedding")
    if queries.count() > config.PASS_QUERIES:
        rows = written(rows, "candidates")
    out = None
    for groups in _passes(queries):
        parts = [(ids[i : i + block], unit[i : i + block]) for ids, unit in groups for i in range(0, len(ids), block)]
        part = rows.mapInPandas(task(rows.sparkSession.sparkContext.broadcast(parts)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


_MATCH = "query_id string, content_id string, similarity double"


def find_similar(
    queries: DataFrame, candidates: DataFrame, threshold: float = config.SIMILARITY_THRESHOLD, block: int = 4096
) -> DataFrame:
    """Candidates with cosine at or above the threshold to a query (E5).

    ``queries``: query_id, query; ``candidates``: content_id, embedding. The
    candidates are read in place, without a shuffle or a join.
    """

    def task(parts):
        def run(batches):
            for batch in batches:
                for ids, unit in parts.value:
                    sims = _cosines(batch, unit)
                    row, col = np.nonzero(sims >= threshold)
                    yield pd.DataFrame(
                        {
                            "query_id": ids[col],
                            "content_id": batch["content_id"].to_numpy()[row],
                            "similarity": sims[row, col],
                        }
                    )

        return run

    return _search(queries, candidates, task, _MATCH, block)


def top_similar(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """The k most similar candidates per query, best first.

    Every task keeps its own best k per query while it reads, so the shuffle
    carries at most k rows per query and task.
    """

    def task(parts):
        def run(batches):
            best = [(np.zeros((0, len(ids))), np.zeros((0, len(ids)), dtype=object)) for ids, _ in parts.value]
            for batch in batches:
                # rows in id order, so that equal similarities keep the smaller id
                batch = batch.sort_values("content_id", kind="stable")
                for i, (_, unit) in enumerate(parts.value):
                    sims = _cosines(batch, unit)
                    first = np.argsort(-sims, axis=0, kind="stable")[:k]
                    s = np.vstack([best[i][0], np.take_along_axis(sims, first, 0)])
                    n = np.vstack([best[i][1], batch["content_id"].to_numpy(dtype=object)[first]])
                    by_name = np.argsort(n.astype(str), axis=0, kind="stable")
                    s, n = np.take_along_axis(s, by_name, 0), np.take_along_axis(n, by_name, 0)
                    order = np.argsort(-s, axis=0, kind="stable")[:k]
                    best[i] = np.take_along_axis(s, order, 0), np.take_along_axis(n, order, 0)
            for (ids, _), (s, n) in zip(parts.value, best):
                yield pd.DataFrame(
                    {"query_id": np.tile(ids, len(s)), "content_id": n.ravel(), "similarity": s.ravel()}
                )

        return run

    found = _search(queries, candidates, task, _MATCH, block)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "content_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
