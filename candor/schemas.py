"""The six tables of the content store."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in columns])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

TEXT_CONTENT = _table(
    ("id", _S, False),
    ("content", _S, False),
    ("source", _S, False),
    ("source_platform", _S, True),
    ("timestamp", _TS, True),
    ("language", _S, True),
    ("word_count", _L, True),
    ("char_count", _L, True),
    ("metadata", _S, True),
    ("created_at", _TS, True),
)

IMAGE_CONTENT = _table(
    ("id", _S, False),
    ("image_url", _S, False),
    ("source", _S, False),
    ("source_platform", _S, True),
    ("timestamp", _TS, True),
    ("width", _L, True),
    ("height", _L, True),
    ("file_size", _L, True),
    ("format", _S, True),
    ("metadata", _S, True),
    ("created_at", _TS, True),
)

AUTHENTICITY_SCORES = _table(
    ("content_id", _S, False),
    ("content_type", _S, False),
    ("authenticity_score", _D, False),
    ("confidence_score", _D, False),
    ("model_version", _S, False),
    ("features", _S, True),
    ("explanation", _S, True),
    ("created_at", _TS, True),
)

EMBEDDINGS = _table(
    ("content_id", _S, False),
    ("content_type", _S, False),
    ("embedding", T.ArrayType(_D), True),
    ("model_name", _S, False),
    ("created_at", _TS, True),
)

CAMPAIGNS = _table(
    ("campaign_id", _S, False),
    ("content_ids", T.ArrayType(_S), True),
    ("similarity_score", _D, False),
    ("campaign_size", _L, False),
    ("detected_at", _TS, True),
    ("campaign_type", _S, True),
    ("metadata", _S, True),
)

CAMPAIGN_MEMBERS = _table(
    ("campaign_id", _S, False),
    ("detection_method", _S, False),
    ("content_id", _S, False),
)

CONTENT_SIMILARITY = _table(
    ("content_id_1", _S, False),
    ("content_id_2", _S, False),
    ("similarity_score", _D, False),
    ("similarity_type", _S, False),
    ("created_at", _TS, True),
)

TABLES = {
    "text_content": TEXT_CONTENT,
    "image_content": IMAGE_CONTENT,
    "authenticity_scores": AUTHENTICITY_SCORES,
    "embeddings": EMBEDDINGS,
    "campaigns": CAMPAIGNS,
    "campaign_members": CAMPAIGN_MEMBERS,
    "content_similarity": CONTENT_SIMILARITY,
}
