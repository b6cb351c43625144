"""Extracts from public corpora, line files and image folders."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor.functions.text import WHITESPACE


@dataclass(frozen=True)
class CorpusSpec:
    """How to read one corpus as content rows."""

    platform: str
    text: str
    id: str
    id_prefix: str
    min_chars: int
    max_chars: int
    timestamp: Column | None = None
    where: Column | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    source: str = "human"
    language: str = "en"


# fixed values: length bounds and id prefixes of the two public corpora
def forum_comments() -> CorpusSpec:
    """Forum dump: id, text, time (epoch seconds), type, deleted, score, parent."""
    return CorpusSpec(
        platform="hackernews",
        text="text",
        id="id",
        id_prefix="hn_",
        min_chars=50,
        max_chars=5000,
        timestamp=F.timestamp_seconds("time"),
        where=(F.col("type") == "comment") & F.col("deleted").isNull(),
        metadata={"score": "score", "parent": "parent", "type": "type"},
    )


def encyclopedia(since: str = "2023-01-01") -> CorpusSpec:
    """Encyclopedia dump: id, title, wiki, datehour."""
    return CorpusSpec(
        platform="wikipedia",
        text="wiki",
        id="id",
        id_prefix="wiki_",
        min_chars=100,
        max_chars=3000,
        where=F.col("datehour") >= F.to_timestamp(F.lit(since)),
        metadata={"title": "title"},
    )


def extract_corpus(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Content rows of one corpus: filter, constant columns, JSON metadata, prefixed ids."""
    size = F.length(spec.text)
    keep = F.col(spec.text).isNotNull() & (size > spec.min_chars) & (size < spec.max_chars)
    if spec.where is not None:
        keep = keep & spec.where
    extra = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in spec.metadata.items()])) if spec.metadata else F.lit("{}")
    return df.where(keep).select(
        F.concat(F.lit(spec.id_prefix), F.col(spec.id).cast("string")).alias("id"),
        F.col(spec.text).alias("content"),
        F.lit(spec.source).alias("source"),
        F.lit(spec.platform).alias("source_platform"),
        (spec.timestamp if spec.timestamp is not None else F.current_timestamp()).alias("timestamp"),
        F.lit(spec.language).alias("language"),
        extra.alias("metadata"),
    )


def sample_rows(df: DataFrame, n: int, seed: int | None = None, id: str = "id") -> DataFrame:
    """``n`` rows in random order (L2); without a seed the order is the hash of the id, which repeats."""
    order = F.md5(F.col(id).cast("string")) if seed is None else F.rand(seed)
    return df.orderBy(order).limit(n)


def collect(*contents: DataFrame) -> DataFrame:
    """Union of content tables; missing columns become null."""
    out = contents[0]
    for more in contents[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def line_items(spark: SparkSession, path: str, text: str = "content") -> DataFrame:
    """One item per non-blank trimmed line, ids ``batch_0``, ``batch_1``, … in file order.

    Lines are numbered inside their input split as they are read; only the
    per-split counts are ordered globally, one row per split.
    """
    lines = (
        spark.read.text(path, lineSep="\n")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.regexp_replace("value", f"^{WHITESPACE}+|{WHITESPACE}+$", "").alias(text),
        )
        .where(F.length(text) > 0)
        .withColumn("pos", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("file", "start").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.col("offset") + F.col("pos") - F.col("first")
    return lines.join(offsets, ["file", "start"]).select(
        F.concat(F.lit("batch_"), number.cast("string")).alias("id"), number.alias("line_no"), text
    )


def load_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, failed): decoded rasters with channel arrays, and undecodable files.

    ``images``: image_id, width, height, r, g, b with row-major arrays of 0..255.
    """
    raw = spark.read.format("image").load(path).select("image.*")

    @F.pandas_udf("r array<int>, g array<int>, b array<int>")
    def channels(data: pd.Series, height: pd.Series, width: pd.Series, step: pd.Series) -> pd.DataFrame:
        found = []
        for raster, h, w, c in zip(data, height, width, step):
            cells = np.frombuffer(raster, np.uint8, h * w * c).reshape(-1, c)  # stored as BGR or gray
            found.append([cells[:, min(c - 1, 2)], cells[:, 1 if c >= 3 else 0], cells[:, 0]])
        return pd.DataFrame(found, columns=["r", "g", "b"])

    images = (
        raw.where("height > 0")
        .withColumn("_c", channels("data", "height", "width", "nChannels"))
        .select(
            F.concat(F.lit("img_"), F.substring(F.md5("origin"), 1, 8)).alias("image_id"), "origin", "width", "height", "_c.r", "_c.g", "_c.b"
        )
    )
    return images, raw.where("height < 0").select("origin")
