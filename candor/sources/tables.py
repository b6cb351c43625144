"""The content store: six catalogue tables, append-only writers, latest-N readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor import config, schemas
from candor.functions.text import words

SIMILARITY_BUCKETS = 64


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer splits than cores.

    A single small file is one split, and the text features above it would run in
    one task. With at least as many splits as cores, as on any large table, the
    rows stay where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, n: int, by: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows; ties go to the smaller id, so the result is stable."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def text_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Shape records for ``text_content``: fill id and timestamp, derive counts, metadata as JSON."""
    has = set(df.columns)
    now = F.current_timestamp() if now is None else now
    optional = lambda name, kind: F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
    metadata = F.lit("{}")
    if "metadata" in has:
        kind = df.schema["metadata"].dataType.typeName()
        metadata = F.col("metadata") if kind == "string" else F.to_json("metadata")
    content = F.col("content")
    return df.select(
        F.coalesce(optional("id", "string"), F.expr("uuid()")).alias("id"),
        content,
        F.col("source"),
        optional("source_platform", "string").alias("source_platform"),
        F.coalesce(optional("timestamp", "timestamp"), now).alias("timestamp"),
        optional("language", "string").alias("language"),
        word_count(content).alias("word_count"),
        F.coalesce(F.length(content), F.lit(0)).cast("long").alias("char_count"),
        F.coalesce(metadata, F.lit("{}")).alias("metadata"),
        F.coalesce(optional("created_at", "timestamp"), now).alias("created_at"),
    )


def score_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    version = F.coalesce(F.col("model_version"), F.lit("v1.0")) if "model_version" in df.columns else F.lit("v1.0")
    features = F.lit("{}")
    if "features" in df.columns:
        kind = df.schema["features"].dataType.typeName()
        features = F.coalesce(F.col("features") if kind == "string" else F.to_json("features"), F.lit("{}"))
    return df.select(
        F.col("content_id").cast("string").alias("content_id"),
        "content_type",
        F.col("authenticity_score").cast("double").alias("authenticity_score"),
        F.col("confidence_score").cast("double").alias("confidence_score"),
        version.alias("model_version"),
        features.alias("features"),
        F.col("explanation") if "explanation" in df.columns else F.lit(None).cast("string").alias("explanation"),
        (F.current_timestamp() if now is None else now).alias("created_at"),
    )


def embedding_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    default = F.lit(config.EMBEDDING_MODEL)
    name = F.coalesce(F.col("model_name"), default) if "model_name" in df.columns else default
    return df.select(
        F.col("content_id").cast("string").alias("content_id"),
        "content_type",
        F.col("embedding").cast("array<double>").alias("embedding"),
        name.alias("model_name"),
        (F.current_timestamp() if now is None else now).alias("created_at"),
    )


class ContentStore:
    """Six tables in one database below ``root`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, database: str, root: str):
        self.spark, self.database, self.root = spark, database, root.rstrip("/")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create(self) -> "ContentStore":
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.root}'")
        for table, schema in schemas.TABLES.items():
            columns = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema
            )
            layout = ""
            if table == "content_similarity":
                layout = (
                    "CLUSTERED BY (content_id_1) SORTED BY (content_id_1, content_id_2) "
                    f"INTO {SIMILARITY_BUCKETS} BUCKETS"
                )
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet {layout}")
        return self

    def append(self, table: str, rows: DataFrame) -> None:
        """Append to an existing table; a null in a required column fails the job."""
        checked = []
        for f in schemas.TABLES[table]:
            value = F.col(f.name).cast(f.dataType)
            if not f.nullable:
                problem = F.raise_error(F.lit(f"{table}.{f.name} must not be null")).cast(f.dataType)
                value = F.coalesce(value, problem)
            checked.append(value.alias(f.name))
        rows.select(*checked).write.insertInto(self.name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def insert_text_content(self, records: DataFrame) -> None:
        self.append("text_content", text_rows(records))

    def insert_authenticity_scores(self, scores: DataFrame) -> None:
        self.append("authenticity_scores", score_rows(scores))

    def insert_embeddings(self, rows: DataFrame) -> None:
        self.append("embeddings", embedding_rows(rows))

    def insert_campaigns(self, campaigns: DataFrame, members: DataFrame) -> None:
        """One row per campaign and one per campaign and content id."""
        self.append("campaigns", campaigns)
        self.append("campaign_members", members)

    def insert_similarity(self, pairs: DataFrame, now: Column | None = None) -> None:
        """Append pairs (content_id_1, content_id_2, similarity_score, similarity_type), each in both directions.

        Rows are dealt by the table's own buckets, so a bucket gets one file a batch and partners of any id lie in one
        bucket, whichever side of the pair it was on. ``similar_pairs`` gives the pairs once again.
        """
        kind = F.coalesce(F.col("similarity_type"), F.lit("semantic"))
        row = lambda a, b: F.struct(F.col(a).alias("content_id_1"), F.col(b).alias("content_id_2"))
        both = F.explode(F.array(row("content_id_1", "content_id_2"), row("content_id_2", "content_id_1"))).alias("e")
        rows = pairs.select("similarity_score", kind.alias("similarity_type"), both).select("e.*", "similarity_score", "similarity_type")
        stamped = rows.withColumn("created_at", F.current_timestamp() if now is None else now)
        self.append("content_similarity", stamped.repartition(SIMILARITY_BUCKETS, "content_id_1"))

    def similar_pairs(self) -> DataFrame:
        """Every stored pair once, the smaller id first."""
        return self.read("content_similarity").where("content_id_1 < content_id_2")

    def partners(self, ids: DataFrame) -> DataFrame:
        """(content_id, partner_id, similarity_score, similarity_type) of the given ids (column ``content_id``).

        The join uses the buckets of the table: only ``ids`` are moved, to as many partitions as there are buckets.
        """
        asked = ids.select(F.col("content_id").cast("string").alias("content_id")).distinct().repartition(SIMILARITY_BUCKETS, "content_id")
        rows = self.read("content_similarity").hint("merge")
        return rows.join(asked, rows["content_id_1"] == asked["content_id"]).select(
            "content_id", F.col("content_id_2").alias("partner_id"), "similarity_score", "similarity_type"
        )

    def text_content(self, limit: int = 1000, source: str | None = None) -> DataFrame:
        rows = self.read("text_content")
        return latest(rows if source is None else rows.where(F.col("source") == source), limit)

    def authenticity_scores(self, content_type: str = "text", limit: int = 1000) -> DataFrame:
        rows = self.read("authenticity_scores").where(F.col("content_type") == content_type)
        return latest(rows, limit, tie="content_id")

    def campaigns(self, limit: int = 100, campaign_type: str | None = None) -> DataFrame:
        rows = self.read("campaigns")
        if campaign_type is not None:
            rows = rows.where(F.col("campaign_type") == campaign_type)
        return latest(rows, limit, by="detected_at", tie="campaign_id")
