"""Vector columns: cosine, normalisation and the hashing text embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor import config
from candor.functions.text import words

_VECTOR_ROWS = 1024  # texts whose bucket counts are taken together


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    A column that is read inside a lambda may be inlined there by the optimizer
    and then be computed per element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def unit(a: Column) -> Column:
    """The vector divided by its norm; a zero vector stays zero."""
    scaled = lambda v, z: F.transform(v, lambda x: F.when(z > 0, x / z).otherwise(0.0))
    return let(a, lambda v: let(norm(v), lambda z: scaled(v, z)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, unequal: Column | None = None) -> Column:
    """Cosine of two arrays; 0 for a zero vector, ``unequal`` (0 by default) for unequal lengths."""
    sizes = norm(a) * norm(b)
    value = F.when(sizes == 0, 0.0).otherwise(_dot(a, b) / sizes)
    return F.when(F.size(a) != F.size(b), F.lit(0.0) if unequal is None else unequal).otherwise(value)


def register_cosine_similarity(spark: SparkSession, name: str = "cosine_similarity") -> None:
    """SQL function ``cosine_similarity(a, b)``: null for unequal lengths, 0 for a zero norm."""
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)
        RETURNS DOUBLE
        RETURN CASE
          WHEN size(a) <> size(b) THEN NULL
          WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0
            OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D
          ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
            / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x))
               * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))
        END
        """
    )


def or_zero_vector(embedding: Column, dim: int = config.FAILED_EMBEDDING_DIM) -> Column:
    """A failed embedding becomes the zero vector, whose cosine with anything is 0."""
    return F.coalesce(embedding, F.array_repeat(F.lit(0.0), dim))


def _bucket(word: bytes, dim: int) -> int:
    """Bucket of a word: the first eight hex digits of its MD5."""
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big") % dim


def bucket_vectors(found: Column, dim: int) -> Column:
    """L2-normalised bucket counts of an array of words; a null array stays null.

    A distinct word of a part of a batch is hashed once, the counts of all rows of the part are taken together.
    """

    @F.arrow_udf("array<double>")
    def vectors(lists: pa.Array) -> pa.Array:
        parts = [lists.slice(i, _VECTOR_ROWS) for i in range(0, len(lists), _VECTOR_ROWS)]
        return pa.concat_arrays([_counted(part, dim) for part in parts] or [pa.array([], pa.list_(pa.float64()))])

    return vectors(found)


def _counted(lists: pa.Array, dim: int) -> pa.Array:
    rows, sizes = len(lists), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    places = np.array([_bucket(w, dim) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype="int64")
    at = np.repeat(np.arange(rows, dtype="int64") * dim, sizes) + places[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(at, minlength=rows * dim).reshape(rows, dim).astype("float64")
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))  # sums of whole numbers: exact
    unit = np.divide(counts, length, out=counts, where=length > 0)
    ends = pa.array(np.arange(rows + 1, dtype="int32") * dim)
    return pa.ListArray.from_arrays(ends, pa.array(unit.ravel()), mask=lists.is_null())


def hashing_embedding(df: DataFrame, text: str = "content", dim: int = config.EMBEDDING_DIM, out: str = "embedding") -> DataFrame:
    """Add the L2-normalised bucket counts of the lower-cased words of the whole text.

    Narrow: no shuffle, one pass over the words of a row, counted in Arrow batches. A text
    without words gets the zero vector.
    """
    return df.withColumn(out, bucket_vectors(words(F.lower(text)), dim))


def embed(df: DataFrame, text: str = "content", model=None, model_name: str | None = None) -> DataFrame:
    """Embedding rows for a content table: hashing by default, or a caller's Arrow pandas UDF."""
    if model is None:
        vectors = hashing_embedding(df, text)
    else:
        vectors = df.withColumn("embedding", or_zero_vector(model(F.col(text))))
    return vectors.select(
        F.col("id").cast("string").alias("content_id"),
        F.lit("text").alias("content_type"),
        "embedding",
        F.lit(model_name or config.EMBEDDING_MODEL).alias("model_name"),
    )
