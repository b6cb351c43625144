"""Rule-based authenticity scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor import config
from candor.functions.text import with_text_features

NO_INDICATORS = "No clear indicators"


def _when(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def _rules(start: float, steps) -> Column:
    """Add signed amounts in the given order, so doubles round the same way every time."""
    total = F.lit(start)
    for condition, amount in steps:
        total = total + _when(condition, amount)
    return total


def _clamp(value: Column, low: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), value))


def _messages(parts) -> Column:
    found = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in parts]))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(F.lit(NO_INDICATORS))


def text_score(features: Column) -> tuple[Column, Column, Column]:
    """Score, confidence and explanation from the text feature struct."""

    def get(name, default):
        return F.coalesce(features[name], F.lit(float(default)))

    phrases = get("ai_phrase_density", 0) > 0.01
    repeated = get("repetition_score", 0) > 0.1
    perfect = get("perfect_punctuation", 0) > 0.5
    formal = get("formal_language_density", 0) > 0.05
    ease = get("flesch_reading_ease", 50)
    varied = get("sentence_length_std", 0) > 5

    score = _rules(
        0.5,
        [
            (phrases, -0.3),
            (repeated, -0.2),
            (perfect, -0.15),
            (formal, -0.1),
            (ease > 70, -0.1),
            (ease < 30, 0.1),
            (varied, 0.1),
        ],
    )
    confidence = _rules(0.5, [(phrases, 0.2), (repeated, 0.1), (perfect, 0.1), (formal, 0.05)])
    explanation = _messages(
        [
            (phrases, "Contains AI-specific phrases"),
            (repeated, "High repetition patterns"),
            (perfect, "Overly perfect punctuation"),
            (formal, "High formal language density"),
            (varied, "Natural sentence length variation"),
        ]
    )
    return _clamp(score, 0.0), _clamp(confidence, 0.1), explanation


def image_score(features: Column) -> tuple[Column, Column, Column]:
    """Score, confidence and explanation from the image feature struct."""

    def get(name, default):
        return F.coalesce(features[name], F.lit(float(default)))

    noise = get("noise_uniformity", 0.5)
    saturation = get("saturation_stddev", 50)
    blocking = get("blocking_artifacts", 0.1)
    edges = get("edge_consistency", 50)
    pattern = get("pattern_repetition", 0)
    natural_blocks = (blocking > 0.01) & (blocking < 0.1)

    score = _rules(
        0.5,
        [
            (noise < 0.1, -0.2),
            (saturation < 20, -0.15),
            (blocking < 0.01, -0.1),
            (edges < 10, -0.1),
            (pattern > 0.1, -0.15),
            (noise > 0.3, 0.1),
            (natural_blocks, 0.05),
        ],
    )
    confidence = _rules(0.5, [(noise < 0.1, 0.1), (saturation < 20, 0.1), (pattern > 0.1, 0.1)])
    explanation = _messages(
        [
            (noise < 0.1, "Uniform noise pattern"),
            (saturation < 20, "Consistent saturation levels"),
            (blocking < 0.01, "Lack of natural compression artifacts"),
            (edges < 10, "Unnaturally consistent edges"),
            (pattern > 0.1, "Repetitive patterns detected"),
            (noise > 0.3, "Natural noise variation"),
            (natural_blocks, "Natural compression artifacts"),
        ]
    )
    return _clamp(score, 0.0), _clamp(confidence, 0.1), explanation


def _scored(df: DataFrame, keep, content_id, kind: str, version: str, rules) -> DataFrame:
    score, confidence, explanation = rules(F.col("features"))
    return df.select(
        *keep,
        content_id.cast("string").alias("content_id"),
        F.lit(kind).alias("content_type"),
        score.alias("authenticity_score"),
        confidence.alias("confidence_score"),
        "features",
        explanation.alias("explanation"),
        F.lit(version).alias("model_version"),
    )


def score_text(df: DataFrame, id: str = "id", text: str = "content", keep=()) -> DataFrame:
    """One score row per text row. Works on batch and streaming input alike.

    ``keep`` names input columns to carry through, ahead of the score columns.
    """
    staged = with_text_features(df.select(*dict.fromkeys([id, text, *keep])), text)
    return _scored(staged, keep, F.col(id), "text", config.TEXT_MODEL_VERSION, text_score)


def score_images(features: DataFrame, id: str = "image_id", keep=()) -> DataFrame:
    """One score row per image feature row (``features`` struct column)."""
    return _scored(features, keep, F.col(id), "image", config.IMAGE_MODEL_VERSION, image_score)


def image_errors(images: DataFrame, origin: Column, message: str = "Failed to load image") -> DataFrame:
    """Zero-score rows for images the source could not decode."""
    return images.select(
        F.concat(F.lit("error_"), F.substring(F.md5(origin), 1, 8)).alias("content_id"),
        F.lit("image").alias("content_type"),
        F.lit(0.0).alias("authenticity_score"),
        F.lit(0.0).alias("confidence_score"),
        F.lit(message).alias("explanation"),
        F.lit(config.IMAGE_MODEL_VERSION).alias("model_version"),
    )


def score_band(score: Column, kind: str = "text") -> Column:
    high, low = ("Likely Human", "Likely AI-Generated") if kind == "text" else ("Likely Real", "Likely AI-Generated")
    return F.when(score > 0.7, high).when(score > 0.3, "Uncertain").otherwise(low)


def predicted_source(score: Column) -> Column:
    return F.when(score > 0.5, "human").otherwise("ai_generated")


def is_low(score: Column) -> Column:
    return score < config.LOW_AUTHENTICITY


def is_high(score: Column) -> Column:
    return score > config.AUTHENTICITY_THRESHOLD
