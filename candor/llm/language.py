"""Language identification with a string kernel (operator 9).

A text is the set of its byte n-grams of several lengths (blended spectrum,
presence only). The kernel is the cosine of two such sets. Landmark texts give a
Nyström map, on which one kernel ridge regression per language is solved. As the
kernel is linear in the presence vector, landmarks and coefficients fold into one
matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import Shared, map_texts, slices
from candor.session import written

ORDERS = (1, 2, 3, 4)  # bytes of an n-gram
BITS = 16  # n-grams are hashed to 2 ** BITS places
SAMPLE_ROWS = 400  # texts per language that a model is fitted on
SAMPLE_TOTAL = 40_000  # texts over all languages; with more of them each gets fewer texts, but one at least
SPARE = 40  # texts drawn beyond twice the sample, so that small samples are filled too
LANDMARKS = 64  # per language
LANDMARKS_TOTAL = 6_400  # over all languages, shared in the same way
RIDGE = 1e-2
BATCH = 64  # texts of one matrix product
UNDETERMINED = "und"


def presence(texts: list[str]) -> np.ndarray:
    """Boolean matrix texts x n-gram places of lower-cased whole texts."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the text's end
    base = np.repeat(np.arange(len(raw), dtype=np.int64) << BITS, sizes)
    found = np.zeros(len(raw) << BITS, bool)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code[: len(data) - n + 1] |= data[n - 1 :] << np.uint32(8 * (n - 1))
        if n in ORDERS:
            inside = left >= n
            mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            place = (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            found[(base + place)[inside]] = True
    return found.reshape(len(raw), 1 << BITS)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, folded weights (places x languages) and the sharpness of the scores."""

    languages: list[str]
    weights: np.ndarray
    sharpness: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and self.languages and any(c.isalpha() for c in t)]
        for start in range(0, len(rows), BATCH):
            part = rows[start : start + BATCH]
            raw = raw_scores(presence([texts[i] for i in part]), self.weights)
            likely = softmax(raw * self.sharpness)
            best = likely.argmax(1)
            for i, k, p in zip(part, best.tolist(), likely.max(1).tolist()):
                names[i], scores[i] = self.languages[k], p
        return names, scores


def raw_scores(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (found.astype(np.float32) @ weights) / np.sqrt(np.maximum(found.sum(1), 1))[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def solve(found: np.ndarray, names: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Nyström features from the first texts of each language, ridge regression on all; ``found`` has packed presence rows."""
    languages = sorted(set(names))
    number = {n: k for k, n in enumerate(languages)}
    y = np.array([number[n] for n in names])
    landmarks = max(1, min(landmarks, LANDMARKS_TOTAL // len(languages)))
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    marks = np.unpackbits(found[chosen], axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    kernel = np.concatenate(
        [raw_scores(np.unpackbits(found[i : i + BATCH], axis=1), marks.T) for i in range(0, len(found), BATCH)]
    ).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ root
    weight = 1 / np.bincount(y)[y]  # every language counts alike
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = (mapped * weight[:, None]).T @ mapped
    solved = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), (mapped * weight[:, None]).T @ target)
    raw = kernel @ solved

    def loss(s):
        return -(weight * np.log(softmax(raw * s)[np.arange(len(y)), y] + 1e-12)).sum()

    return LanguageModel(languages, (marks.T @ solved).astype(np.float32), min((1, 2, 3, 4, 6, 8), key=loss))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from about ``sample_rows`` texts of each non-null language.

    Presence vectors of whole texts are worked out in tasks; only they reach the driver.
    Where the languages are so many that this exceeds ``SAMPLE_TOTAL`` texts, each
    gets an equal share of the total, at least one text. Each language's
    distinct texts are thinned by their hash at a rate from their number, so only the
    bounded sample reaches the driver, copies of a text leave the others their places,
    and a repeated run draws the same. Texts without letters are not learned from. An empty table gives a
    model that answers ``und``.
    """
    rows = docs.select(F.col(lang).alias("_lang"), F.col(text).cast("string").alias("_text")).where(
        "_lang is not null and _text rlike '\\\\p{L}'"
    )
    # copies of a text count once, in the rate as in the sample
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    distinct = written(hashed.select("_lang", "_hash").distinct(), "language-texts")
    counts = distinct.groupBy("_lang").count()
    sample_rows = max(1, min(sample_rows, SAMPLE_TOTAL // max(counts.count(), 1)))
    draw = F.pmod("_hash", F.lit(1 << 30))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_hash"))
    chosen = (
        distinct.join(F.broadcast(counts), "_lang")
        .withColumn("_draw", draw)
        .where(F.col("_draw") * F.col("count") < F.lit(2 * sample_rows + SPARE) * F.lit(float(1 << 30)))
        .withColumn("_place", place)
        .where(F.col("_place") <= sample_rows)
        .select("_lang", "_hash", "_draw")
    )
    whole = (
        hashed.join(F.broadcast(chosen), ["_lang", "_hash"])
        .groupBy("_lang", "_hash", "_draw")
        .agg(F.min("_text").alias("_text"))
        .select(F.col("_lang").cast("string"), "_draw", "_hash", "_text")
    )
    taken = whole.mapInArrow(packed, "_lang string, _draw long, _hash long, _found binary").collect()
    taken = sorted(taken, key=lambda r: (r["_draw"], r["_lang"], r["_hash"]))
    if not taken:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), 1.0)
    return solve(np.array([np.frombuffer(r["_found"], np.uint8) for r in taken]), [r["_lang"] for r in taken])


def packed(batches):
    """Presence bits of whole texts, 8 kB each at any length."""
    for batch in batches:
        for part in slices(batch, "_text"):
            bits = [np.packbits(presence([t.as_py()])[0]).tobytes() for t in part.column(3)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(bits, pa.binary())],
                names=["_lang", "_draw", "_hash", "_found"],
            )


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score of every whole text.

    Null texts and those without a letter are ``und`` with score 0. Columns named
    like the new ones are replaced.
    """
    shared = Shared(docs.sparkSession, model)

    def make():
        return lambda texts: list(shared.value.predict(texts))

    return map_texts(docs, text, make, [T.StructField(lang, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])
