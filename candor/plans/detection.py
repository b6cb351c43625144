"""Multi-signal campaign detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor import config
from candor.functions.scoring import score_text
from candor.functions.vectors import hashing_embedding
from candor.operators import blocks, clusters, rollups
from candor.operators import campaigns as rules
from candor.operators.intervals import interval_statistics, is_regular, regular_groups
from candor.operators.skew import lookup
from candor.session import cut_lineage, written

# fixed values: stored type per family; the similarity families carry the family name
CAMPAIGN_TYPES = {
    "similarity_campaigns": "text_similarity",
    "semantic_campaigns": "semantic_campaigns",
    "temporal_campaigns": "temporal_campaigns",
    "network_campaigns": "network_campaigns",
    "cross_platform_campaigns": "cross_platform_campaigns",
    "authenticity_campaigns": "authenticity_pattern",
    "behavioral_campaigns": "platform_behavior",
    "volume_spikes": "volume_spike",
    "length_pattern_campaigns": "length_pattern",
    "multimodal_campaigns": "multimodal_temporal",
}
_STANDARD = ("campaign_key", "campaign_size", "avg_similarity", "similarity_score")


@dataclass
class Detection:
    """Unified findings: ``campaigns`` (one row each) and ``members`` (long form)."""

    campaigns: DataFrame
    members: DataFrame

    def summary(self) -> DataFrame:
        return rollups.family_counts(self.campaigns)

    def suspicious_count(self) -> DataFrame:
        return rollups.suspicious_count(self.members)


def unify(families: dict[str, tuple[DataFrame, DataFrame]]) -> Detection:
    """Bring the families to one schema.

    The similarity is the mean similarity, else a similarity score, else 0; all
    other columns of a finding go to ``details`` as JSON.
    """
    found, held = None, None
    for method, (campaigns, members) in families.items():
        similarity = next((F.col(c) for c in ("avg_similarity", "similarity_score") if c in campaigns.columns), F.lit(0.0))
        extra = [c for c in campaigns.columns if c not in _STANDARD]
        rows = campaigns.select(
            F.col("campaign_key").alias("campaign_id"),
            F.lit(CAMPAIGN_TYPES.get(method, method)).alias("campaign_type"),
            F.lit(method).alias("detection_method"),
            F.col("campaign_size").cast("long").alias("campaign_size"),
            F.coalesce(similarity, F.lit(0.0)).alias("similarity_score"),
            (F.to_json(F.struct(*extra)) if extra else F.lit("{}")).alias("details"),
        )
        ids = members.select(
            F.col("campaign_key").alias("campaign_id"), F.lit(method).alias("detection_method"), "content_id"
        )
        found = rows if found is None else found.unionByName(rows)
        held = ids if held is None else held.unionByName(ids)
    return Detection(found, held)


def similarity_family(groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal similarity (J3, ``pairs.equal_similarity_groups``) as a family, stored as ``text_similarity``."""
    name = F.concat(F.lit("similarity_"), F.col("similarity").cast("string")).alias("campaign_key")
    return groups.select(name, "campaign_size", "avg_similarity"), members.select(name, "content_id")


def stored_rows(detection: Detection, detected_at: Column | None = None) -> DataFrame:
    """Rows of the ``campaigns`` table (S5): one per campaign, whatever its size.

    The ids are the rows of ``campaign_members`` (``detection.members``), since no
    bound holds for their number; ``content_ids`` is null.
    """
    return detection.campaigns.select(
        "campaign_id",
        F.lit(None).cast("array<string>").alias("content_ids"),
        "similarity_score",
        "campaign_size",
        (F.current_timestamp() if detected_at is None else detected_at).alias("detected_at"),
        "campaign_type",
        F.to_json(F.struct("detection_method", "details")).alias("metadata"),
    )


def embedded(content: DataFrame) -> DataFrame:
    """Embedding, length, time and platform per row, written once; the text is read once."""
    rows = content.select(
        F.col("id").cast("string").alias("id"),
        "content",
        "timestamp",
        "source_platform",
        F.length("content").alias("content_length"),
    )
    return written(hashing_embedding(rows).drop("content"), "embedded")


def analysed(content: DataFrame) -> DataFrame:
    """As ``embedded``, with the scores of the rows from the same pass over the text."""
    kept = ("id", "timestamp", "source_platform", "content_length", "embedding")
    rows = hashing_embedding(
        content.select(
            F.col("id").cast("string").alias("id"),
            "content",
            "timestamp",
            "source_platform",
            F.length("content").alias("content_length"),
        )
    )
    return written(score_text(rows, keep=kept).drop("features"), "analysed")


def coordinated_families(
    rows: DataFrame, intervals: DataFrame | None = None, block_rows: int = config.PAIR_BLOCK_ROWS
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Semantic, temporal, network and cross-platform findings of materialised rows (R2).

    Semantic clusters and cross-platform matches have one threshold, so one comparison of the vectors serves both.
    The temporal rule compares inside hours only, where its own cells keep it far below that.
    """
    vectors = written(rules.platform_members(rows, "id", "source_platform", "embedding"), "vectors")
    reps = written(blocks.representatives(vectors, "platform"), "distinct")
    samples = config.CLUSTER_MIN_SAMPLES
    passed = clusters.pass_over(reps, config.SIMILARITY_THRESHOLD, samples, block_rows, platforms=True)
    named = _or_none("platform")
    members, found = clusters.cluster_findings(
        vectors.withColumn("platform", named), reps.withColumn("platform", named), passed, samples, ("vkey", "platform")
    )
    matches = passed.where("kind = 'platform'").select("rep", "platform", "other", F.col("n").alias("matches"))
    name = F.concat(F.lit("cluster_"), F.col("cluster")).alias("campaign_key")
    return {
        "semantic_campaigns": (
            found.select(name, F.col("cluster_size").alias("campaign_size"), "avg_similarity"),
            members.select(name, "content_id"),
        ),
        "temporal_campaigns": rules.temporal_patterns(rows, block_rows=block_rows),
        "network_campaigns": interval_family(rows, "network_", 0.1, intervals),
        "cross_platform_campaigns": rules.cross_platform_findings(
            rules.platform_sizes(rows, "source_platform"), vectors.where("platform is not null"), reps, matches
        ),
    }


def _or_none(platform: str) -> Column:
    """A platform to join by: rows without one are a group like any other."""
    return F.concat(F.when(F.col(platform).isNull(), "-").otherwise("+"), F.coalesce(platform, F.lit("")))


def interval_family(
    rows: DataFrame, prefix: str, factor: float, intervals: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Regular posters as a family: network (0.1) and platform behaviour (0.2)."""
    if intervals is None:
        intervals = cut_lineage(interval_statistics(rows))
    flagged = intervals.withColumn("is_regular", is_regular(factor))
    name = F.concat(F.lit(prefix), F.col("source_platform")).alias("campaign_key")
    found = flagged.where("is_regular").select(
        name,
        F.col("source_platform").alias("platform"),
        "campaign_size",
        (F.col("avg_interval") / 60).alias("avg_posting_interval_minutes"),
        "posting_regularity",
    )
    return found, regular_groups(rows, flagged).select(name, "content_id")


def detect_coordinated(
    content: DataFrame, min_size: int = config.CAMPAIGN_MIN_SIZE, block_rows: int = config.PAIR_BLOCK_ROWS
) -> Detection:
    """R2 on a content table; below ``min_size`` rows there are no findings."""
    if content.limit(min_size).count() < min_size:
        content = content.limit(0)
    return unify(coordinated_families(embedded(content), block_rows=block_rows))


def detect_all(
    content: DataFrame, images: DataFrame | None = None, limit: int | None = None, block_rows: int = config.PAIR_BLOCK_ROWS
) -> Detection:
    """Every family over a content table.

    The whole table by default; ``limit`` takes the newest rows instead. The text
    is read once; every family works on the columns it needs of the written result.
    """
    if limit is not None:
        content = content.orderBy(F.desc("created_at"), "id").limit(limit)
    rows = analysed(content)
    intervals = cut_lineage(interval_statistics(rows))
    families = coordinated_families(rows, intervals, block_rows)
    families["authenticity_campaigns"] = rules.authenticity_patterns(rows, scores=rows)
    families["behavioral_campaigns"] = interval_family(rows, "platform_behavior_", 0.2, intervals)
    families["volume_spikes"] = rules.volume_spikes(rows)
    families["length_pattern_campaigns"] = rules.length_patterns(rows, length="content_length")
    if images is not None:
        families["multimodal_campaigns"] = rules.multimodal(rows, images)
    return unify(families)
