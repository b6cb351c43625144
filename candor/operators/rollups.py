"""Roll-ups behind the dashboard and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.scoring import is_high, is_low, predicted_source


def content_stats(df: DataFrame) -> DataFrame:
    """Rows, mean words and mean characters per source and platform (A1)."""
    return (
        df.groupBy("source", "source_platform")
        .agg(
            F.count("*").alias("content_count"),
            F.avg("word_count").alias("avg_word_count"),
            F.avg("char_count").alias("avg_char_count"),
        )
        .orderBy(F.desc("content_count"), "source", "source_platform")
    )


def source_counts(df: DataFrame) -> DataFrame:
    """Total, human and generated rows in one pass."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "human").alias("human"),
        F.count_if(F.col("source") == "ai_generated").alias("ai_generated"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def daily_volume(df: DataFrame, ts: str = "created_at", sources=("human", "ai_generated", "unknown")) -> DataFrame:
    """Rows per day, one zero-filled column per source."""
    days = df.groupBy(F.to_date(ts).alias("date")).pivot("source", list(sources)).count()
    return days.na.fill(0, list(sources))


def timeline(df: DataFrame, ts: str = "timestamp", by: str = "source") -> DataFrame:
    """Rows per hour and source in long form (A10)."""
    return df.groupBy(F.date_trunc("hour", ts).alias("hour"), by).agg(F.count("*").alias("n"))


def histogram_bin(value: Column, bins: int) -> Column:
    return F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")


def score_histogram(scores: DataFrame, column: str = "authenticity_score", bins: int = 20, by=(), weight: str | None = None) -> DataFrame:
    """Equal-width bins over 0..1; 1.0 falls into the last one (A11). ``weight`` names a column with the rows that each row stands for."""
    n = F.count("*") if weight is None else F.sum(weight)
    return scores.groupBy(histogram_bin(F.col(column), bins).alias("bin"), *by).agg(n.alias("n"))


def score_statistics(scores: DataFrame) -> DataFrame:
    """Mean score, mean confidence, low and high counts."""
    s = F.col("authenticity_score")
    return scores.agg(
        F.avg(s).alias("avg_authenticity"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.count_if(is_low(s)).alias("low_count"),
        F.count_if(is_high(s)).alias("high_count"),
        F.count("*").alias("total"),
    )


def score_points(scores: DataFrame, keep=()) -> DataFrame:
    """Score and confidence per item."""
    return scores.select("content_id", *keep, "authenticity_score", "confidence_score")


def prediction_accuracy(scores: DataFrame, expected: str = "expected") -> DataFrame:
    """Share of items whose predicted source equals the expected one (P5)."""
    judged = scores.withColumn("correct", predicted_source(F.col("authenticity_score")) == F.col(expected))
    return judged.agg(
        F.count("*").alias("samples"),
        F.count_if("correct").alias("correct"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("confidence_score").alias("avg_confidence"),
    )


def suspicious_count(members: DataFrame, families=("semantic_campaigns", "temporal_campaigns", "network_campaigns")) -> DataFrame:
    """Distinct content ids over the given families (A6); cross-platform ids do not count."""
    return members.where(F.col("detection_method").isin(*families)).agg(
        F.count_distinct("content_id").alias("total_suspicious_content")
    )


def family_counts(campaigns: DataFrame) -> DataFrame:
    """Campaigns per family."""
    return campaigns.groupBy("detection_method").agg(F.count("*").alias("campaigns"))


def top_campaigns(campaigns: DataFrame, k: int = 5) -> DataFrame:
    """The k largest campaigns per family (W3); the limit is pushed below the shuffle."""
    order = Window.partitionBy("detection_method").orderBy(F.desc("campaign_size"), "campaign_id")
    return campaigns.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def alert_rules(
    metrics: DataFrame, min_accuracy: float = 0.8, max_latency: float = 60.0, max_error_rate: float = 0.05, by=()
) -> DataFrame:
    """Alerts from a metrics table with columns correct, latency_seconds, failed."""
    rates = metrics.groupBy(*by).agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.max("latency_seconds").alias("max_latency"),
        F.avg(F.col("failed").cast("double")).alias("error_rate"),
    )
    return rates.select(
        "*",
        (F.col("accuracy") < min_accuracy).alias("accuracy_alert"),
        (F.col("max_latency") > max_latency).alias("latency_alert"),
        (F.col("error_rate") > max_error_rate).alias("error_alert"),
    )
