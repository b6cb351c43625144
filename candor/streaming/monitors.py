"""Streaming counterparts of the hourly and scoring operators.

All queries run with ``availableNow`` by default, so a scheduled run drains what
has arrived and stops; pass ``processingTime`` for a continuous one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candor import config
from candor.functions.scoring import score_text
from candor.session import scratch_path


def _start(writer, trigger: dict | None) -> StreamingQuery:
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def hourly_volume(rows: DataFrame, ts: str = "timestamp", by: str = "source_platform") -> DataFrame:
    """Rows per hour and platform of a batch or micro-batch."""
    return rows.groupBy(F.date_trunc("hour", ts).alias("hour"), by).agg(F.count("*").alias("n"))


def score_stream(stream: DataFrame, id: str = "id", text: str = "content") -> DataFrame:
    """Scores as they arrive: the batch projection on a streaming frame."""
    return score_text(stream, id, text)


def write_parquet(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once append to a Parquet folder."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), trigger)


def write_batches(stream: DataFrame, handle, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``handle(batch, batch_id)``."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode(mode), trigger)


def latest_counts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "timestamp",
    by: str = "source_platform",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hourly counts of every micro-batch, one folder each.

    No hour is ever closed: a late row is counted in the batch that brings it, and
    no state is kept. Rewriting a batch folder is idempotent, so a restarted batch
    leaves no duplicates; ``newest_counts`` adds the batches up, ``compact_counts`` folds them into one.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        hourly_volume(batch, ts, by).write.mode("overwrite").options(**_MARKED).parquet(f"{path}/batch={batch_id}")

    return write_batches(stream, save, checkpoint, "append", trigger)


_MARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "true"}  # a folder counts from its commit file on


def _folders(spark: SparkSession, path: str, key: str) -> dict[int, str]:
    """Finished ``key=number`` folders below ``path`` by number: those whose writing was committed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    out = {}
    for status in files.listStatus(root):
        place = status.getPath()
        name = place.getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
        if name.startswith(f"{key}=") and files.exists(done):
            out[int(name.split("=", 1)[1])] = place.toString()
    return out


def compact_counts(spark: SparkSession, path: str, by: str = "source_platform") -> int | None:
    """Fold all finished batch folders into one; returns the last batch number it holds, None without any.

    The fold is written to ``compacted/until=N`` and counts as soon as its commit file is there; from then on readers leave out
    batches up to N, so a batch that is written again after a restart counts once. A fold that broke off has no commit file
    and is written again. Folders are deleted one fold late, so that a reader that planned before keeps its files.
    """
    batches, folds = _folders(spark, path, "batch"), _folders(spark, f"{path}/compacted", "until")
    before = max(folds, default=-1)
    fresh = [n for n in batches if n > before]
    if not fresh:
        return before if folds else None
    until = max(fresh)
    newest_counts(spark, path, by).coalesce(1 + len(fresh) // 100).write.mode("overwrite").options(**_MARKED).parquet(f"{path}/compacted/until={until}")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [p for n, p in batches.items() if n <= before] + [p for n, p in folds.items() if n < before]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return until


def newest_counts(spark: SparkSession, path: str, by: str = "source_platform") -> DataFrame:
    """Hourly counts of everything that arrived: the newest fold (``compact_counts``) and the batches after it."""
    folds = _folders(spark, f"{path}/compacted", "until")
    last = max(folds, default=-1)
    parts = [folds[last]] if folds else []
    parts += [p for n, p in sorted(_folders(spark, path, "batch").items()) if n > last]
    if not parts:
        return spark.createDataFrame([], f"hour timestamp, `{by}` string, n long")
    # every folder holds the same columns; the numbers in their names are no columns of the counts
    return spark.read.parquet(*parts).groupBy("hour", by).agg(F.sum("n").alias("n"))


def spike_alerts(counts: DataFrame, baseline: DataFrame, min_size: int = config.CAMPAIGN_MIN_SIZE, deviations: float = 2.0) -> DataFrame:
    """Hours above the baseline's mean + 2 deviations.

    ``baseline``: one row (mean, std), refreshed by a batch job; it is read again
    for every micro-batch.
    """
    limit = baseline.select(F.col("mean") + deviations * F.col("std")).scalar()
    hourly = counts.groupBy("hour").agg(F.sum("n").alias("n"))
    return hourly.where((F.col("n") > limit) & (F.col("n") >= min_size))


def campaign_rate_alert(campaigns: DataFrame, per_hour: int = 10) -> DataFrame:
    """Hours in which more than ``per_hour`` campaigns were detected."""
    hourly = campaigns.groupBy(F.date_trunc("hour", "detected_at").alias("hour")).agg(
        F.count_distinct("campaign_id").alias("new_campaigns")
    )
    return hourly.where(F.col("new_campaigns") > per_hour)


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and surface its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (output, checkpoint) folders in the shared workspace."""
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
