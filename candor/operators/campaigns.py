"""Campaign rules. Every rule returns ``(campaigns, members)``.

``campaigns`` has one row per finding; ``members`` maps campaign_key to
content_id in long form, so a campaign may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor import config
from candor.functions.scoring import is_low, score_text
from candor.operators import blocks
from candor.operators.skew import balanced_join, lookup
from candor.session import cut_lineage, written


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))


def hour_text(hour: str = "hour") -> Column:
    return F.date_format(hour, "yyyyMMdd_HH")


def _ids(df: DataFrame, id: str, *keep) -> DataFrame:
    return df.select(F.col(id).cast("string").alias("content_id"), *keep)


def _members(rows: DataFrame, campaigns: DataFrame, on: str) -> DataFrame:
    """Rows of the flagged groups; heavy groups are broadcast, so they stay spread out."""
    table = campaigns.select(on, "campaign_key", F.col("campaign_size").alias("weight"))
    return lookup(rows, table, [on], "weight").select("campaign_key", "content_id")


def hourly_counts(df: DataFrame, ts: str = "timestamp", by=()) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(hour_of(ts).alias("hour"), *by).agg(F.count("*").alias("n"))


def volume_spikes(
    df: DataFrame, id: str = "id", ts: str = "timestamp", min_size: int = config.CAMPAIGN_MIN_SIZE, deviations: float = 2.0
) -> tuple[DataFrame, DataFrame]:
    """Hours with more rows than mean + 2 sample deviations of the hourly counts (A3)."""
    hourly = cut_lineage(hourly_counts(df, ts))  # one row per hour; read three times below
    level = hourly.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))
    mean = level.select("mean").scalar()
    limit = level.select(F.col("mean") + deviations * F.col("std")).scalar()
    spikes = hourly.where((F.col("n") > limit) & (F.col("n") >= min_size)).select(
        F.concat(F.lit("volume_spike_"), hour_text()).alias("campaign_key"),
        "hour",
        F.col("n").alias("campaign_size"),
        (F.col("n") / mean).alias("volume_multiplier"),
    )
    return spikes, _members(_ids(df, id, hour_of(ts).alias("hour")), spikes, "hour")


def length_bucket(length: Column) -> Column:
    size = length.cast("double")
    return F.floor(size / (size * 0.1 + 10)).cast("int")


def length_patterns(
    df: DataFrame,
    id: str = "id",
    text: str = "content",
    min_size: int = config.CAMPAIGN_MIN_SIZE,
    limit: float = 0.1,
    length: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Length buckets whose lengths vary by less than 10 % (A4); at most ten buckets.

    ``length`` names a column with the lengths, where they are known already.
    """
    size = F.length(text) if length is None else F.col(length)
    rows = _ids(df.where(size.isNotNull()), id, size.cast("long").alias("len")).withColumn(
        "bucket", length_bucket(F.col("len"))
    )
    n, s, q = F.count("*"), F.sum("len"), F.sum(F.col("len") * F.col("len"))
    stats = cut_lineage(rows.groupBy("bucket").agg(n.alias("campaign_size"), s.alias("s"), q.alias("q")))
    # n*q - s*s in decimals: exact, so equal lengths give a deviation of exactly 0
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    std = F.sqrt((wide("campaign_size") * wide("q") - wide("s") * wide("s")).cast("double")) / F.col("campaign_size")
    mean = F.col("s") / F.col("campaign_size")
    cv = F.when(mean > 0, std / mean).otherwise(0.0)
    found = (
        stats.where(F.col("campaign_size") >= min_size)
        .select("bucket", "campaign_size", mean.alias("avg_length"), cv.alias("cv"))
        .where(F.col("cv") < limit)
        .select(
            F.concat(F.lit("length_pattern_"), F.col("bucket")).alias("campaign_key"),
            "bucket",
            "campaign_size",
            "avg_length",
            (1 - F.col("cv")).alias("length_consistency"),
        )
    )
    return found, _members(rows, found, "bucket")


def authenticity_patterns(
    df: DataFrame, id: str = "id", text: str = "content", min_size: int = config.CAMPAIGN_MIN_SIZE, scores: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Low-score rows grouped by the first 50 characters of their explanation (A5).

    The rule messages allow only a few dozen explanations, whatever the data.
    ``scores`` are materialised scores of the rows, where the caller has them.
    """
    scored = scores
    if scored is None:
        # scored once for both results; the filter below must not pull the features into its condition
        scored = cut_lineage(score_text(df, id, text).select("content_id", "authenticity_score", "explanation"))
    low = scored.where(is_low(F.col("authenticity_score"))).select(
        "content_id", "authenticity_score", F.substring("explanation", 1, 50).alias("common_explanation")
    )
    found = (
        low.groupBy("common_explanation")
        .agg(F.count("*").alias("campaign_size"), F.avg("authenticity_score").alias("avg_authenticity_score"))
        .where(F.col("campaign_size") >= min_size)
        .select(
            F.concat(F.lit("auth_"), F.substring(F.md5("common_explanation"), 1, 8)).alias("campaign_key"),
            "common_explanation",
            "campaign_size",
            "avg_authenticity_score",
        )
    )
    return found, _members(low, found, "common_explanation")


def temporal_patterns(
    df: DataFrame,
    id: str = "id",
    ts: str = "timestamp",
    vector: str = "embedding",
    threshold: float = config.TEMPORAL_SIMILARITY,
    min_size: int = config.CAMPAIGN_MIN_SIZE,
    block_rows: int = config.BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Hours with at least ``min_size`` rows and one similar pair inside the hour (A2).

    All rows of the hour belong to the campaign. The similar pairs are counted
    inside the blocks, not listed.
    """
    hourly = cut_lineage(hourly_counts(df, ts).where(F.col("n") >= min_size))
    # rows of other hours drop out with ``hourly`` below; to sort them out here would move every vector once more
    timed = df.select(id, vector, hour_of(ts).alias("hour")).where("hour is not null")
    reps = written(blocks.representatives(blocks.unit_members(timed, id, vector, ["hour"]), "hour"), "distinct")
    placed = blocks.place(reps, threshold, scope="hour", prune="scope", block_rows=block_rows)
    across = blocks.blocked_join(placed, blocks.scope_count_kernel, "scope long, pairs long", threshold, scope="hour", prune="scope")
    pairs = across.groupBy("scope").agg(F.sum("pairs").alias("pairs"))
    own = F.sum(F.col("copies") * (F.col("copies") - 1) / 2).cast("long")
    within = reps.groupBy("hour").agg(own.alias("own")).withColumn("scope", F.xxhash64("hour"))
    found = (
        within.join(pairs, "scope", "left")
        .withColumn("similar_pairs_count", F.col("own") + F.coalesce("pairs", F.lit(0)))
        .where("similar_pairs_count > 0")
        .join(hourly, "hour")
        .select(
            F.concat(F.lit("temporal_"), hour_text()).alias("campaign_key"),
            "hour",
            F.col("n").alias("campaign_size"),
            "similar_pairs_count",
        )
    )
    found = cut_lineage(found)
    return found, _members(_ids(df, id, hour_of(ts).alias("hour")), found, "hour")


def cross_platform(
    df: DataFrame,
    id: str = "id",
    platform: str = "source_platform",
    vector: str = "embedding",
    threshold: float = config.SIMILARITY_THRESHOLD,
    min_rows: int = 2,
    min_matches: int = 2,
    block_rows: int = config.BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Platform pairs with at least two similar cross pairs.

    Rows of a platform with the same vector are folded first, and the blocks
    report match counts per row and other platform instead of the match list
    (``cross_platform_matches`` lists it). Vectors of different lengths do not match.
    """
    members = written(platform_members(df, id, platform, vector), "vectors")
    reps = written(blocks.representatives(members.where("platform is not null"), "platform"), "distinct")
    placed = blocks.place(reps, threshold, block_rows=block_rows)
    schema = "rep string, platform string, other string, matches long"
    partial = blocks.blocked_join(placed, blocks.platform_kernel(), schema, threshold, carry=["platform"])
    return cross_platform_findings(platform_sizes(df, platform), members, reps, partial, min_rows, min_matches)


def platform_sizes(df: DataFrame, platform: str) -> DataFrame:
    return df.groupBy(F.col(platform).cast("string").alias("platform")).agg(F.count("*").alias("weight"))


def platform_members(df: DataFrame, id: str, platform: str, vector: str) -> DataFrame:
    """(id, platform, vkey, vec) of every row with a vector."""
    return blocks.unit_members(df.select(id, vector, F.col(platform).cast("string").alias("platform")), id, vector, ["platform"])


def cross_platform_findings(
    sizes: DataFrame, members: DataFrame, reps: DataFrame, partial: DataFrame, min_rows: int = 2, min_matches: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Campaigns and members from match counts per block pair: ``partial`` has rep, platform, other, matches.

    Platforms with fewer than ``min_rows`` rows take no part.
    """
    sizes = sizes.where(F.col("weight") >= min_rows)
    hits = cut_lineage(partial.groupBy("rep", "platform", "other").agg(F.sum("matches").alias("matches")))
    hits = hits.join(sizes.select("platform"), "platform", "left_semi").join(sizes.select(F.col("platform").alias("other")), "other", "left_semi")
    hits = cut_lineage(hits.join(reps.select("rep", "platform", "vkey", "copies"), ["rep", "platform"]))
    ordered = hits.withColumn("platform_1", F.least("platform", "other")).withColumn("platform_2", F.greatest("platform", "other"))
    key = F.concat_ws("_", F.lit("cross_platform"), "platform_1", "platform_2")
    found = cut_lineage(
        ordered.groupBy("platform_1", "platform_2")
        .agg(
            # each match is seen from both sides
            F.sum(F.when(F.col("platform") == F.col("platform_1"), F.col("copies") * F.col("matches"))).alias("matches"),
            F.sum("copies").alias("campaign_size"),
        )
        .where(F.col("matches") >= min_matches)
        .select(key.alias("campaign_key"), "platform_1", "platform_2", "campaign_size", "matches")
    )
    named = found.select("platform_1", "platform_2", "campaign_key", F.col("campaign_size").alias("weight"))
    flagged = lookup(ordered, named, ["platform_1", "platform_2"], "weight").select(
        "platform", "vkey", "copies", "campaign_key"
    )
    ids = members.select(F.col("id").alias("content_id"), "platform", "vkey")
    return found, lookup(ids, flagged, ["platform", "vkey"], "copies").select("campaign_key", "content_id")


def cross_platform_matches(pairs: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """The match list behind J5: listed pairs whose ids sit on different platforms.

    ``platforms``: content_id, platform (one row per id). Pairs that carry platform_1 and platform_2 need none and are not shuffled.
    """
    if platforms is None:
        both = pairs.withColumnsRenamed({"platform_1": "p1", "platform_2": "p2"}).where("p1 <> p2")
    else:
        one = platforms.select(F.col("content_id").alias("content_id_1"), F.col("platform").alias("p1"))
        two = platforms.select(F.col("content_id").alias("content_id_2"), F.col("platform").alias("p2"))
        first = cut_lineage(balanced_join(cut_lineage(pairs), one, ["content_id_1"]))
        both = balanced_join(first, two, ["content_id_2"]).where("p1 <> p2")
    swap = F.col("p1") > F.col("p2")
    return both.select(
        F.least("p1", "p2").alias("platform_1"),
        F.greatest("p1", "p2").alias("platform_2"),
        F.when(swap, F.col("content_id_2")).otherwise(F.col("content_id_1")).alias("content_id_1"),
        F.when(swap, F.col("content_id_1")).otherwise(F.col("content_id_2")).alias("content_id_2"),
        F.col("similarity_score").alias("similarity"),
    )


def multimodal(
    texts: DataFrame, images: DataFrame, id: str = "id", ts: str = "timestamp", min_rows: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Hours with at least two texts and two images (J6); members carry their kind."""
    t = hourly_counts(texts, ts).withColumnRenamed("n", "texts").where(F.col("texts") >= min_rows)
    i = hourly_counts(images, ts).withColumnRenamed("n", "images").where(F.col("images") >= min_rows)
    found = cut_lineage(t.join(i, "hour")).select(
        F.concat(F.lit("multimodal_"), hour_text()).alias("campaign_key"),
        "hour",
        (F.col("texts") + F.col("images")).alias("campaign_size"),
        "texts",
        "images",
    )
    table = found.select("hour", "campaign_key", F.col("campaign_size").alias("weight"))
    rows = _ids(texts, id, hour_of(ts).alias("hour"), F.lit("text").alias("content_type")).unionByName(
        _ids(images, id, hour_of(ts).alias("hour"), F.lit("image").alias("content_type"))
    )
    return found, lookup(rows, table, ["hour"], "weight").select("campaign_key", "content_id", "content_type")


def shared_hours(one: DataFrame, two: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hours that occur on both sides (L4)."""
    return one.select(hour_of(ts).alias("hour")).intersect(two.select(hour_of(ts).alias("hour")))


def in_hours(df: DataFrame, hours: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows of the given hours."""
    rows = df.withColumn("hour", hour_of(ts))
    counts = rows.groupBy("hour").agg(F.count("*").alias("_rows")).join(hours.select("hour").distinct(), "hour", "left_semi")
    return lookup(rows, cut_lineage(counts), ["hour"], "_rows")
