"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor import config


def small_enough(df: DataFrame, rows: int = config.BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    weight: str,
    heavy_keys: int = config.HEAVY_KEYS,
    small: int = config.BROADCAST_ROWS,
    total: int | None = None,
) -> DataFrame:
    """Join ``rows`` with a table of one row per key that knows each key's row count.

    Keys above 1/``heavy_keys`` of all rows number fewer than ``heavy_keys``, so
    they go through a broadcast and their rows never gather in one task; all
    other keys go through an ordinary shuffled join. ``weight`` is dropped.
    ``total`` is the sum of the weights where the caller already knows it.
    """
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    if total <= small:
        return rows.join(table.drop(weight), on)
    heavy = F.broadcast(table.where(F.col(weight) > total / heavy_keys))
    light = table.where(F.col(weight) <= total / heavy_keys)
    return rows.join(heavy.drop(weight), on).unionByName(
        rows.join(heavy.select(*on), on, "left_anti").join(light.drop(weight), on)
    )


def balanced_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    heavy_keys: int = config.HEAVY_KEYS,
    small: int = config.BROADCAST_ROWS,
    salts: int = 64,
) -> DataFrame:
    """Join ``rows`` (materialised, any number per key) with ``table`` on ``on``.

    The row counts per key are taken from ``rows``. The table rows of heavy keys
    are broadcast if a count shows that they are few; otherwise their key is
    salted: the rows are spread over ``salts`` parts and the table rows repeated.
    """
    total = rows.count()
    if total <= small:
        return rows.join(table, on)
    heavy = rows.groupBy(*on).count().where(F.col("count") > total / heavy_keys).select(*on)
    heavy = F.broadcast(heavy)
    hot_rows, hot_table = rows.join(heavy, on, "left_semi"), table.join(heavy, on, "left_semi")
    if small_enough(hot_table, small):
        hot = hot_rows.join(F.broadcast(hot_table), on)
    else:
        others = [c for c in rows.columns if c not in on]
        part = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
        repeated = hot_table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hot = hot_rows.withColumn("_salt", part).join(repeated, [*on, "_salt"]).drop("_salt")
    return hot.unionByName(rows.join(heavy, on, "left_anti").join(table, on))
