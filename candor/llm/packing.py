"""Best-fit packing of token pieces into sequences (operator 7).

Bounded-space online best-fit: at most ``open_bins`` sequences are open in a
task. A bitset has a bit for every free space that some open sequence has, so the
tightest fit is the lowest set bit at or above the piece's length; when one more
sequence would be open than allowed, the fullest closes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.bpe import shared
from candor.llm.common import slices, without

OPEN_BINS = 16_384
BLOCK = 16_384  # pieces that a task takes from its stream at once, longest first
TASK_BITS = 33  # a task numbers its sequences from its own number times 2 ** 33


class BestFit:
    """Open sequences of one task."""

    def __init__(self, capacity: int, open_bins: int, base: int):
        self.capacity, self.most, self.next = capacity, open_bins, base
        self.spaces = 0  # bit f: some open sequence has f tokens free
        self.bins: dict[int, list[int]] = {}
        self.open = 0

    def _put(self, space: int, sequence: int) -> None:
        if space:
            self.bins.setdefault(space, []).append(sequence)
            self.spaces |= 1 << space
            self.open += 1

    def _take(self, space: int) -> int:
        held = self.bins[space]
        sequence = held.pop()
        if not held:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.capacity, self.next
            self.next += 1
            if length < self.capacity and self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest
        self._put(space - length, sequence)
        return sequence, self.capacity - space


def pieces(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 1024,
    end_id: int | None = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its token ids and ``end_id``. Longer ones are cut into pieces of
    ``max_tokens``, of which the first may be shorter. A null or empty text is
    ``end_id`` alone (nothing, where ``end_id`` is None). Every row is a document
    of its own, also if ids repeat or are null.
    """
    table = shared(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    fields = [
        rows.schema["doc_id"],
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False), False))
    end = np.array([] if end_id is None else [end_id], "<u4")

    def task(batches):
        bpe = table.value
        for batch in batches:
            for part in slices(batch, "_text"):
                ids, counts = bpe.encode(part.column(1).to_pylist())
                row, number, start, length, crc, kept = [], [], [], [], [], []
                for i, own in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                    own = np.concatenate([own, end]).astype("<u4", copy=False)
                    at, k, n = 0, 0, len(own) % max_tokens or max_tokens
                    while at < len(own):
                        cut = own[at : at + n]
                        row.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            kept.append(cut.astype(np.int32))
                        at, k, n = at + n, k + 1, max_tokens
                columns = [
                    part.column(0).take(pa.array(row, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(task, T.StructType(fields))


def pack(rows: DataFrame, capacity: int = 1024, length: str = "length", open_bins: int = OPEN_BINS, block: int = BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: a place for every row in sequences of ``capacity`` tokens.

    Rows are dealt evenly by a hash of their values and of their place in the input, so no source or length is
    hot and equal rows are spread as well, and every task packs its own in an order that a repeated run over the same files keeps. Rows
    of length null or 0 or less take no space (sequence and offset null); longer
    ones than ``capacity`` are an error. Columns named like the new ones are replaced.
    """
    rows = without(rows, ["sequence_id", "offset"])
    at, width = rows.columns.index(length), len(rows.columns)
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    place = F.monotonically_increasing_id()  # the same for a task that runs again over the same split
    dealt = rows.withColumn("_deal", F.xxhash64(place, *plain)).repartition("_deal").sortWithinPartitions("_deal")
    out = T.StructType(
        [*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def task(batches):
        from pyspark import TaskContext

        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << TASK_BITS)
        for batch in _blocks(batches, block):
            sizes = np.nan_to_num(batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
            if len(sizes) and sizes.max() > capacity:
                raise ValueError(f"a piece of {sizes.max()} tokens for sequences of {capacity}")
            order = np.argsort(-sizes, kind="stable")
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for i in order.tolist():
                if sizes[i] > 0:
                    sequence[i], offset[i] = bins.place(int(sizes[i]))
            none = sizes <= 0
            columns = [batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, mask=none), pa.array(offset, mask=none)], names=out.names
            )

    return dealt.mapInArrow(task, out)


def _blocks(batches, most: int):
    """Batches of ``most`` rows from a stream of batches."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
