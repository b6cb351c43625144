"""Adapters from the given tables to the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.sources.corpus import encyclopedia, extract_corpus, forum_comments
from candor.sources.tables import spread

PHRASE = " As an AI language model, furthermore it is important to note this."
RASTER_WIDTH = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them: a stream's path has to be a folder or a pattern."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def minutes_after_start(minutes) -> F.Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(mins=minutes.cast("int"))).cast("timestamp")


def text_content(spark: SparkSession, sf: str) -> DataFrame:
    """documents and labels as the content table; every seventh text gets a listed phrase."""
    docs, labels = documents(spark, sf), table(spark, sf, "labels").select("doc_id", "quality")
    source = F.when(F.col("quality") == 1, "human").when(F.col("quality") == 0, "ai_generated").otherwise("unknown")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(PHRASE))).otherwise(F.col("text"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        text.alias("content"),
        source.alias("source"),
        F.col("source").alias("source_platform"),
        minutes_after_start(F.col("doc_id") * 7).alias("timestamp"),
        F.col("lang").alias("language"),
        F.to_json(F.struct("n_chars")).alias("metadata"),
        minutes_after_start(F.col("doc_id") * 7 + 60).alias("created_at"),
    )


def event_posts(spark: SparkSession, sf: str) -> DataFrame:
    """events as posts: the event type is the platform."""
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("source_platform"),
        "props",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("content_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat(F.lit("kind"), F.col("label")).alias("content_type"),
    )


def forum_rows(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as a forum dump."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "text",
        (F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("time"),
        F.when(F.col("role") == "system", "story").otherwise("comment").alias("type"),
        F.when(F.col("turn") > 5, True).alias("deleted"),
        F.col("turn").alias("score"),
        F.col("conv_id").alias("parent"),
    )


def encyclopedia_rows(spark: SparkSession, sf: str) -> DataFrame:
    """documents as an encyclopedia dump, one hour apart from 2022-12-31."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("page "), F.col("doc_id")).alias("title"),
        F.col("text").alias("wiki"),
        (F.lit("2022-12-31 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int")))
        .cast("timestamp")
        .alias("datehour"),
    )


def forum(spark: SparkSession, sf: str) -> DataFrame:
    return extract_corpus(forum_rows(spark, sf), forum_comments())


def encyclopedia_pages(spark: SparkSession, sf: str) -> DataFrame:
    return extract_corpus(encyclopedia_rows(spark, sf), encyclopedia())


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an image, 64 characters per line, colours from the code points."""
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c) % 256)
    height = F.ceil(F.length("text") / RASTER_WIDTH).cast("int")
    fill = F.array_repeat(F.lit(32), (height * RASTER_WIDTH - F.length("text")).cast("int"))
    return (
        documents(spark, sf)
        .where(F.length("text") > 0)
        .select(
            F.col("doc_id").cast("string").alias("image_id"),
            F.lit(RASTER_WIDTH).alias("width"),
            height.alias("height"),
            F.concat(codes, fill).alias("r"),
        )
        .select(
            "*",
            F.transform("r", lambda v, i: (v * 3 + i) % 256).alias("g"),
            F.transform("r", lambda v: (v * 7) % 256).alias("b"),
        )
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as short posts."""
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("content"),
        F.col("role").alias("source_platform"),
    )
