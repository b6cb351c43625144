"""Word-overlap pairs (J4): an exact prefix-filtered token join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor import config
from candor.operators.overlap_counts import hash_seed, pair_counts
from candor.operators.skew import balanced_join, lookup
from candor.session import cut_lineage, written

_HEAD = 256  # ids that a top-k search looks at first
_SET_ROWS, _SET_WORDS = 512, 4096  # sets and words whose hits are counted in one product


def token_set(text: Column) -> Column:
    """Distinct lower-cased pieces between single spaces, empty pieces included."""
    return F.array_sort(F.array_distinct(F.split(F.lower(text), " ")))


def distinct_token_sets(df: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets): texts with the same words share one set row, named by its smallest id."""
    rows = df.select(F.col(id).cast("string").alias("id"), token_set(F.col(text)).alias("tokens"))
    key = F.concat(F.hex(F.xxhash64("tokens")), F.hex(F.xxhash64(F.lit(17), "tokens")))
    members = written(rows.withColumn("key", key), "word-sets")
    sets = members.groupBy("key").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")
    )
    sets = written(sets, "distinct-word-sets")
    table = sets.select("key", "first_id", F.col("copies").alias("weight"))
    named = lookup(members.select("id", "key"), table, ["key"], "weight").select("id", F.col("first_id").alias("key"))
    return named, sets.withColumn("key", F.col("first_id"))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """Each set with its tokens as (df, token hash), the rarest first: ``ts``; the order is the same for all sets.

    ``df`` is the number of sets with the token. Counts are attached by a join that broadcasts only the few heavy tokens.
    """
    hashed = F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("token")
    postings = cut_lineage(sets.select("first_id", hashed))
    counts = cut_lineage(postings.groupBy("token").agg(F.count("*").alias("df")))
    counted = lookup(postings, counts.withColumn("weight", F.col("df")), ["token"], "weight")
    ranked = counted.groupBy("first_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    return cut_lineage(
        sets.select("first_id", "last_id", "copies", F.size("tokens").alias("size")).join(ranked, "first_id")
    )


def overlap_set_pairs(sets: DataFrame, ordered: DataFrame, min_ratio: float = 0.5, posting: int = 2_000) -> DataFrame:
    """(key_1, key_2, ratio): |A and B| / |A| > ``min_ratio`` over ordered pairs of sets.

    Exact prefix filter with a count. At least k + 1 tokens must be shared, with k = floor(min_ratio * |A|). Some of
    A's tokens are probed, the rarest first; the rest can supply only so many shared tokens, so a pair with fewer
    probe hits than what is missing is out without being looked at. Low ratios leave out 0.8 k tokens and ask for many hits, high ones
    leave out k - 2 and ask for three. A hit at place i of A and j of B (both in the order of
    rarity) bounds the shared tokens by min(i, j) before it and by what is left of either set behind it; hits
    that cannot belong to a pair are not joined. Hits are counted
    on token hashes, where a collision can only add a candidate; the ratio comes
    from the tokens themselves. Posting lists above ``posting`` rows are split
    over salts on one side and replicated on the other.
    """
    required = F.floor(F.col("size") * min_ratio)
    rest = F.greatest(F.floor(required * 0.8), required - 2) if min_ratio >= 0.8 else F.floor(required * 0.8)
    probed = (F.col("size") - rest).cast("int")
    salts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("t.df") / posting))
    left = ordered.select(
        F.col("first_id").alias("key_1"), F.col("size").alias("size_1"), F.col("copies").alias("copies_1"), required.alias("required"),
        (required + 1 - rest).alias("needed"), F.posexplode(F.slice("ts", F.lit(1), probed)).alias("place_1", "t"),
    ).select("*", F.col("t.token").alias("token"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).drop("t")
    right = ordered.select(
        F.col("first_id").alias("key_2"), F.col("size").alias("size_2"), F.col("last_id").alias("last_2"), F.posexplode("ts").alias("place_2", "t"),
    ).select("*", F.col("t.token").alias("token"), F.pmod(F.xxhash64("key_2"), salts).alias("salt")).drop("t")
    # a pair needs an id of A below an id of B, and B at least as many tokens as must be shared
    useful = (F.col("key_1") < F.col("last_2")) & (F.col("size_2") > F.col("required"))
    behind = F.least(F.col("size_1") - F.col("place_1"), F.col("size_2") - F.col("place_2"))
    useful &= F.least("place_1", "place_2") + behind > F.col("required")
    differs = (F.col("key_1") != F.col("key_2")) | (F.col("copies_1") > 1)
    candidates = (
        left.join(right, ["token", "salt"])
        .where(useful & differs)
        .groupBy("key_1", "key_2")
        .agg(F.count("*").alias("hits"), F.max("needed").alias("needed"))
        .where("hits >= needed")
        .select("key_1", "key_2")
    )
    candidates = cut_lineage(candidates)
    one = sets.select(F.col("first_id").alias("key_1"), F.col("tokens").alias("t1"))
    two = sets.select(F.col("first_id").alias("key_2"), F.col("tokens").alias("t2"))
    shared = F.size(F.array_intersect("t1", "t2"))
    return (
        balanced_join(balanced_join(candidates, one, ["key_1"]), two, ["key_2"])
        .select("key_1", "key_2", (shared / F.size("t1")).alias("word_overlap_ratio"))
        .where(F.col("word_overlap_ratio") > min_ratio)
    )


def _all_pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    one = members.select(F.col("key").alias("key_1"), F.col("id").alias("content_id_1"))
    two = members.select(F.col("key").alias("key_2"), F.col("id").alias("content_id_2"))
    first = cut_lineage(balanced_join(cut_lineage(found), one, ["key_1"]))
    return balanced_join(first, two, ["key_2"]).where("content_id_1 < content_id_2").select(
        "content_id_1", "content_id_2", "word_overlap_ratio"
    )


def _first_partners(found: DataFrame, members: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(word_overlap_ratio, content_id_1, key_2, copies) of the k smallest ids of each first set, where the second one has a larger id."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    smallest = members.withColumn("nth", nth).where(F.col("nth") <= k)
    one = smallest.select(F.col("key").alias("key_1"), F.col("id").alias("content_id_1"))
    two = sets.select(F.col("key").alias("key_2"), "last_id", "copies")
    return cut_lineage(
        balanced_join(balanced_join(found, two, ["key_2"]), one, ["key_1"])
        .where("content_id_1 < last_id")
        .select("word_overlap_ratio", "content_id_1", "key_2", "copies")
    )


def _top_pairs(firsts: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best pairs by (ratio, id_1, id_2) without listing the others.

    Every (ratio, id_1) with a partner yields at least one pair, so the answer
    lies within the k best of those, and per set only its k smallest ids can be
    among them. Each row is then compared with at most k ids.
    """
    best_first = [F.desc("word_overlap_ratio"), F.asc("content_id_1")]
    heads = firsts.select("word_overlap_ratio", "content_id_1").distinct().orderBy(*best_first).limit(k)
    wanted = firsts.join(F.broadcast(heads), ["word_overlap_ratio", "content_id_1"], "left_semi")
    rows = members.select(F.col("key").alias("key_2"), F.col("id").alias("content_id_2"))
    pairs = lookup(rows, wanted, ["key_2"], "copies").where("content_id_1 < content_id_2")
    return (
        pairs.select("content_id_1", "content_id_2", "word_overlap_ratio")
        .orderBy(*best_first, "content_id_2")
        .limit(k)
    )


def _holding(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(key_1, key_2, word_overlap_ratio): the sets that hold all words of one of the ``asked`` sets, which travel to the tasks.

    Every set is read once where it lies; words are compared as they are.
    """
    rows = asked.select("key", "tokens", "copies").collect()
    lists = pa.array([r["tokens"] for r in rows], pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    place, size = words.indices.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    keys, copied = np.array([r["key"] for r in rows], dtype=object), np.array([r["copies"] > 1 for r in rows])
    held = sets.sparkSession.sparkContext.broadcast((words.dictionary, place, np.repeat(np.arange(len(rows)), size), size, keys, copied))

    def run(batches):
        known, place, owner, size, keys, copied = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, _SET_ROWS):
                part = batch.slice(start, _SET_ROWS)
                tokens, names = part.column("tokens"), part.column("key").to_numpy(zero_copy_only=False)
                coded = tokens.flatten().dictionary_encode()
                column = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(part.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False))
                shared = np.zeros((len(keys), part.num_rows), dtype="float32")
                for low in range(0, len(known), _SET_WORDS):
                    one, two = (np.zeros((n, _SET_WORDS), dtype="float32") for n in (len(keys), part.num_rows))
                    for to, at, of in ((one, place, owner), (two, column, row)):
                        here = (at >= low) & (at < low + _SET_WORDS)
                        to[of[here], at[here] - low] = 1
                    shared += one @ two.T
                a, b = np.nonzero(shared == size[:, None])
                fit = (keys[a] != names[b]) | copied[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a[fit]], pa.string()), pa.array(names[b[fit]], pa.string()), pa.array(np.ones(fit.sum()))],
                    names=["key_1", "key_2", "word_overlap_ratio"],
                )

    return sets.where("key is not null").select("key", "tokens").mapInArrow(run, "key_1 string, key_2 string, word_overlap_ratio double")


def _head_partners(members: DataFrame, sets: DataFrame, k: int, head: int) -> DataFrame | None:
    """As ``_first_partners`` of the sets of the ``head`` smallest ids, for sets that hold them whole; None if those are fewer than k pairs.

    No ratio is above 1, and among equal ratios the smallest first id comes first, so k such pairs settle a top-k search, whatever the rest holds.
    """
    ids = members.where("id is not null").orderBy("id").limit(head + 1).collect()
    if len(ids) <= head:
        return None  # a table this small is searched at once
    asked = sets.where(F.col("key").isin(sorted({r["key"] for r in ids[:head]})))
    found = written(_holding(sets, asked).distinct(), "holding")
    firsts = _first_partners(found, members, sets, k)
    return firsts if firsts.where(F.col("content_id_1") < ids[head]["id"]).limit(k).count() >= k else None


#: ratios that a top-k search starts from, one after the other, until k pairs lie above one
DESCENT = (0.95, 0.8)


def word_overlap_pairs(
    df: DataFrame, id: str = "id", text: str = "content", min_words: int = 5, min_ratio: float = 0.5, limit: int | None = 20, head: int = _HEAD
) -> DataFrame:
    """Pairs id_1 < id_2 by share of the first text's words found in the second, best first.

    ``limit`` is the reported top-k; None lists every pair. The top-k search first looks for texts that hold all words of those with the
    ``head`` smallest ids, in one pass over the sets; k such pairs are the answer. Else it descends: it joins at a high ratio, where few tokens
    are probed, and goes on to the next lower one only if fewer than k pairs lie above it.
    """
    rows = df.where((F.col("word_count") > min_words) & F.col(text).isNotNull())
    members, sets = distinct_token_sets(rows, id, text)
    if limit is None:
        return _all_pairs(overlap_set_pairs(sets, ordered_sets(sets), min_ratio), members)
    firsts = _head_partners(members, sets, limit, head) if min_ratio < 1 else None
    if firsts is not None:
        return _top_pairs(firsts, members, limit)
    ordered = ordered_sets(sets)
    for ratio in [*(r for r in DESCENT if r > min_ratio), min_ratio]:
        found = cut_lineage(overlap_set_pairs(sets, ordered, ratio))
        # each pair of sets stands for one pair of ids at least
        if ratio == min_ratio or found.limit(limit).count() >= limit:
            break
    return _top_pairs(_first_partners(found, members, sets, limit), members, limit)


def _id_sets(df: DataFrame, id: str, text: str, chunk: int) -> DataFrame:
    """(key, tokens, ids): texts with the same words share a row, about ``chunk`` ids of a set in one; null ids are left out.

    Tokens are hashes that keep the words apart.
    """
    rows = df.select(F.col(id).cast("string").alias("id"), token_set(F.col(text)).alias("tokens")).where("id is not null")
    seed = hash_seed(rows)
    key = F.concat(F.hex(F.xxhash64("tokens")), F.hex(F.xxhash64(F.lit(17), "tokens")))
    hashed = F.transform("tokens", lambda t: F.xxhash64(F.lit(seed), t))
    members = written(rows.select("id", key.alias("key"), hashed.alias("tokens")), "word-sets")
    copied = members.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    part = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / chunk)))
    # sets of more ids than a chunk number fewer than one in chunk rows
    sets = members.join(F.broadcast(copied), "key", "left").groupBy("key", part.alias("part")).agg(
        F.first("tokens").alias("tokens"), F.collect_list("id").alias("ids")
    )
    return written(sets.drop("part"), "distinct-word-sets")


def word_overlap_counts(
    df: DataFrame, id: str = "id", text: str = "content", min_words: int = 5, min_ratio: float = 0.5, chunk: int = 1_000, block_rows: int = config.PAIR_BLOCK_ROWS
) -> DataFrame:
    """(word_overlap_ratio, n): how many pairs id_1 < id_2 have each ratio above ``min_ratio`` (A11 over J4), without a pair being listed.

    Sets are compared block by block inside the tasks (``overlap_counts.pair_counts``); pairs of copies follow from their number.
    """
    rows = df.where((F.col("word_count") > min_words) & F.col(text).isNotNull())
    sets = _id_sets(rows, id, text, chunk)
    found = pair_counts(sets, min_ratio, block_rows)
    if min_ratio < 1:
        ends = sets.groupBy("key").agg(F.sum(F.size("ids")).alias("copies"), F.min(F.array_min("ids")).alias("low"), F.max(F.array_max("ids")).alias("high"))
        copied = ends.where("low < high").select(F.lit(1.0).alias("word_overlap_ratio"), F.expr("copies * (copies - 1) div 2").alias("n"))
        found = found.unionByName(copied)
    return found.groupBy("word_overlap_ratio").agg(F.sum("n").alias("n"))
