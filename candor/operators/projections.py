"""Row-level projections (P1-P10): labels, ratios, previews, ids, buckets, JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_authentic(source: Column) -> Column:
    """Label of a row: human sources are authentic."""
    return F.when(source == "human", True).otherwise(False)


def char_share(text: Column, char: str) -> Column:
    """Share of one character, from the length lost by removing it."""
    lost = F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
    return F.try_divide(lost, F.length(text))


def classifier_rows(df: DataFrame, labelled_only: bool = True, min_words: int | None = None) -> DataFrame:
    """Numeric columns and label of the authenticity classifier.

    ``labelled_only`` keeps human and AI rows; ``min_words`` keeps longer texts.
    """
    rows = df.where(F.col("content").isNotNull())
    if labelled_only:
        rows = rows.where(F.col("source").isin("human", "ai_generated"))
    if min_words is not None:
        rows = rows.where(F.col("word_count") > min_words)
    text = F.col("content")
    return rows.select(
        "id",
        "word_count",
        "char_count",
        F.try_divide(F.length(text), F.col("word_count")).alias("avg_word_length"),
        char_share(text, " ").alias("space_ratio"),
        char_share(text, ".").alias("period_ratio"),
        char_share(text, ",").alias("comma_ratio"),
        is_authentic(F.col("source")).alias("is_authentic"),
    )


def without(df: DataFrame, *columns: str) -> DataFrame:
    """All columns except the named ones."""
    return df.drop(*columns)


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters and an ellipsis, for display only."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def image_id(path: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(F.md5(path), 1, 8))


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def day_bucket(ts: Column) -> Column:
    return F.to_date(ts)


def json_field(doc: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(doc, path).cast(kind)
