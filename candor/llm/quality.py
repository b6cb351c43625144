"""Compression classifier for text quality (operator 2).

Two zstandard dictionaries are built from good and from bad labelled text. A text
is compressed in blocks with either one; the difference of the two
sizes, divided by the text's own size, goes through a logistic calibration
that is fitted on labelled rows the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import Shared, map_texts, slices

SAMPLE_ROWS = 3000  # labelled rows per class that a model is fitted on, half of them for the dictionaries
SAMPLE_BLOCKS = 12_000  # blocks of whole texts that a dictionary is made of; of more, those with the smallest hashes
DICTIONARY_BYTES = 65_536
BLOCK_BYTES = 2_048
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (good, bad), scaling and weights; a few 100 kB. Without weights the prior is the score."""

    dictionaries: tuple[bytes, bytes] | None
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def compressors(self):
        import zstandard

        made = []
        for raw in self.dictionaries:
            kind = zstandard.DICT_TYPE_AUTO
            content = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            content.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )
        return made

    def scorer(self):
        if self.dictionaries is None:
            return lambda texts: np.full(len(texts), self.prior)
        pair = self.compressors()

        def score(texts):
            found = np.array([difference(t or "", pair) for t in texts]).reshape(-1, 1)
            z = self.weights[0] + ((found - self.centre) / self.spread) @ self.weights[1:]
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def difference(text: str, pair) -> float:
    """Compressed size by the bad dictionary less that by the good one, by the text's size."""
    raw = memoryview(text.encode())
    good = bad = 0
    for i in range(0, len(raw), BLOCK_BYTES):
        block = raw[i : i + BLOCK_BYTES]
        good += len(pair[0].compress(block))
        bad += len(pair[1].compress(block))
    return (bad - good) / (len(raw) + 20)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their end, DICTIONARY_BYTES of it, is the dictionary itself."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b" " * 16


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * curve[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS, sample_blocks: int = SAMPLE_BLOCKS,
) -> QualityModel:
    """A model from at most ``sample_rows`` rows of each label (1 good, 0 bad).

    The rows with the smallest hashes of their ids are taken, so a repeated run
    takes the same; only their ids (bounded by ``sample_rows``) are broadcast. The
    calibration rows are compressed whole inside tasks. Dictionaries are made of all blocks of their rows' whole
    texts; where a class has more than ``sample_blocks`` of them, a draw by hash from all over the texts bounds what reaches the driver.
    With too few blocks to train on, the text itself is the dictionary.
    Other labels and nulls are ignored; an id that stands in several rows of ``labels`` may bring its text to both classes. Without rows of both classes the model
    answers with the share of label 1, or 0.5.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    none = QualityModel(None, np.zeros(1), np.ones(1), np.zeros(2), prior)
    if len(counts) < 2:
        return none
    chosen = [
        marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for y in (0, 1)
    ]
    whole = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
        .join(F.broadcast(chosen[0].union(chosen[1])), "_id")
        .where("_text is not null")
        .withColumn("_hash", F.xxhash64("_text"))
    )
    keys = (
        whole.select("_id", "_y", "_hash")
        .orderBy(F.xxhash64("_id"), "_id", "_hash")
        .limit(2 * sample_rows)  # an id that stands in several rows could else bring more
        .collect()
    )
    keys = list(dict.fromkeys((r["_id"], r["_hash"], r["_y"]) for r in keys))
    by = {y: [k for k in keys if k[2] == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return none
    half = {y: (len(t) + 1) // 2 for y, t in by.items()}
    rest = {y: t[half[y] :] or t for y, t in by.items()}

    def picked(wanted):
        """Whole texts of the keys, each once, with the key's number."""
        numbered = docs.sparkSession.createDataFrame(
            [(*k, i) for i, k in enumerate(wanted)], T.StructType([whole.schema["_id"], whole.schema["_hash"], whole.schema["_y"], T.StructField("_at", T.LongType())])
        )
        return whole.join(F.broadcast(numbered), ["_id", "_hash", "_y"]).groupBy("_at").agg(F.min("_text").alias("_text"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                for at, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = text.encode()
                    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())],
                        names=["at", "part", "block"],
                    )

    def samples(wanted):
        blocks = picked(wanted).select("_at", "_text").mapInArrow(cut, "at long, part long, block binary")
        drawn = blocks.orderBy(F.xxhash64("at", "part"), "at", "part").limit(sample_blocks).collect()
        return [bytes(r["block"]) for r in sorted(drawn, key=lambda r: (r["at"], r["part"]))]

    books = tuple(dictionary(samples(by[y][: half[y]])) for y in (1, 0))
    shared = Shared(docs.sparkSession, QualityModel(books, none.centre, none.spread, none.weights, prior))

    def make():
        pair = shared.value.compressors()
        return lambda texts: [np.array([difference(t or "", pair) for t in texts])]

    columns = [T.StructField("_less", T.DoubleType(), False)]
    rated = map_texts(picked(rest[0] + rest[1]), "_text", make, columns).select("_at", "_less").collect()
    x = np.array([(r["_less"],) for r in sorted(rated, key=lambda r: r["_at"])])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.repeat([(1 - prior) / len(rest[0]), prior / len(rest[1])], [len(rest[0]), len(rest[1])]) * len(y)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    return QualityModel(books, centre, spread, logistic((x - centre) / spread, y, weight), prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the calibrated probability of good quality of every whole text.

    Null and empty texts get the score of an empty text. Equal texts get equal
    scores. A column named like ``out`` is replaced.
    """
    shared = Shared(docs.sparkSession, model)

    def make():
        scorer = shared.value.scorer()
        return lambda texts: [scorer(texts)]

    return map_texts(docs, text, make, [T.StructField(out, T.DoubleType(), False)])
