"""Small helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20  # text that one numpy step works on; a longer text is a slice of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (case is ignored, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


class Shared:
    """An object of this package in a broadcast, its class included: executors need no copy of the package.

    A worker process loads it once and keeps it for its later tasks.
    """

    def __init__(self, spark: SparkSession, value):
        self.raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.raw, "loaded"):
            self.raw.loaded = pickle.loads(self.raw.value)
        return self.raw.loaded


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``most`` bytes of ``column`` each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``fields`` computed from the text column, slice by slice.

    ``make`` runs once per task and returns the function from texts (None for
    null) to one Arrow-convertible sequence per field. Columns of ``df`` with the
    names of ``fields`` are replaced. ``keep`` names the other columns to carry.
    """
    names = [f.name for f in fields]
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    rows = df.withColumn("_text", F.col(text).cast("string"))
    rows = without(rows, names) if keep is None else rows.select("_text", *[F.col(f"`{c}`") for c in keep])
    out = T.StructType([f for f in rows.schema.fields if f.name != "_text"] + fields)

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        work = make()
        for batch in batches:
            for part in slices(batch, "_text"):
                at = part.schema.get_field_index("_text")
                made = work(part.column(at).to_pylist())
                old = [part.column(i) for i in range(part.num_columns) if i != at]
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(old + new, names=out.names)

    return rows.mapInArrow(task, out)
