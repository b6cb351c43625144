"""Spelling variant grouping with PartEnum signatures (operator 13).

A word is the multiset of its letters, seen as a binary vector over (letter,
occurrence) places. One inserted, deleted or replaced code point changes at most two
places. The places are dealt into parts; two vectors at Hamming distance two or less agree on
all but two parts, so they share one of the signatures that leave out two parts each. An edit also leaves the first or the
last three code points of a word alone, so each signature is taken with either end. Equal signatures
are joined, and the join verifies each pair by its edit distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import Shared
from candor.session import written

RUN = "[a-zÀ-ÿ]+"  # fixed value: a run after A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROPPED = 199  # fixed value: a run loses a code point where this divides its hash
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5  # fixed values: of words, and of a form's count to the word's
DISTANCE = 2  # places that one edit changes at most
PARTS = 5  # parts that the places are dealt into; signatures leave out DISTANCE of them
END = 3  # code points of an end; one edit of a word of 2 * END code points leaves an end whole
HOT = 2_000  # words of one signature and length that one task compares with each other


def counted_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, n): lower-cased letter runs of whole texts after the hashed deletions; all of them, also rare ones."""
    body = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    id = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(id.alias("id"), F.explode(F.regexp_extract_all(body, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DROPPED == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def places(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every code point: its letter and how often the letter stood before it in the word."""
    texts = words.to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    letter = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((letter, row))
    row, letter = row[order], letter[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])
    at = np.arange(len(row))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return row, (letter << 32) + nth


def place_counts(words: DataFrame) -> dict[int, int]:
    """Words per place for the first MANY occurrences of a letter: as many rows as letters times MANY, at most."""

    def task(batches):
        for batch in batches:
            _, place = places(batch.column(0))
            values, counts = np.unique(place[(place & 0xFFFFFFFF) < MANY], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["place", "n"])

    found = words.select("word").mapInArrow(task, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    return {r["place"]: r["n"] for r in found.collect()}


MANY = 8  # occurrences of a letter that are weighed when places are dealt; later ones go by a hash


def deal(counts: dict[int, int], parts: int) -> dict[int, int]:
    """Part of every place, so that all parts tell words apart about equally well. Any dealing gives the same pairs."""
    total = max(counts.values(), default=1) + 1
    share = {p: n / total for p, n in counts.items()}
    weight = {p: -(s * np.log(s) + (1 - s) * np.log(1 - s)) for p, s in share.items()}
    load = [0.0] * parts
    part = {}
    for p in sorted(weight, key=lambda p: (-weight[p], p)):
        part[p] = load.index(min(load))
        load[part[p]] += weight[p]
    return part


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def part_sums(words: pa.Array, part: dict[int, int], parts: int) -> np.ndarray:
    """Per part and word the sum of the hashed places: equal projections have equal sums."""
    row, place = places(words)
    known = np.array(sorted(part), np.int64)
    home = np.array([part[p] for p in sorted(part)], np.int64)
    hashed = _mixed(place.astype(np.uint64) + np.uint64(1))
    where = (hashed % np.uint64(parts)).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, place), len(known) - 1)
        where = np.where(known[at] == place, home[at], where)
    sums = np.zeros((parts, len(words)), np.uint64)
    np.add.at(sums, (where, row), hashed)
    return sums


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, size, sig): every signature of every word, with its first and with its last END code points."""
    shared = Shared(words.sparkSession, deal(place_counts(words), parts))
    kept = list(itertools.combinations(range(parts), parts - DISTANCE))

    def task(batches):
        dealt = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                word, n = (batch.column(i).slice(start, 10_000) for i in range(2))
                sums = part_sums(word, dealt, parts)
                texts = word.to_pylist()
                salt = np.arange(1, parts + 1, dtype=np.uint64)
                whole = [_mixed(sum((_mixed(sums[j] + salt[j]) * (np.uint64(2) * salt[j] + np.uint64(1)) for j in c), np.zeros(len(word), np.uint64)) + np.uint64(k))
                         for k, c in enumerate(kept)]
                ends = []
                for side, end in ((1, [t[:END] for t in texts]), (2, [t[-END:] for t in texts])):
                    code = np.zeros(len(word), np.uint64)
                    for letter in np.frombuffer("".join(end).encode("utf-32-le"), np.uint32).reshape(-1, END).T:
                        code = _mixed(code * np.uint64(1_000_003) + letter.astype(np.uint64))
                    ends.append(_mixed(code + np.uint64(side)))
                sig = np.stack([_mixed(w + np.uint64(3) * e) for w in whole for e in ends])
                size = pa.array(np.array([len(t) for t in texts], np.int32))
                for s in sig:
                    yield pa.RecordBatch.from_arrays([word, n, size, pa.array(s.view(np.int64))], names=["word", "n", "size", "sig"])

    return words.select("word", "n").mapInArrow(task, "word string, n long, size int, sig long")


def near_words(words: DataFrame, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """(word_1, n_1, word_2, n_2), word_1 < word_2: all pairs of words that one edit of a code point parts.

    Words have at least 2 * END code points. The words of a signature with more than ``hot`` of them are spread
    over salts on one side and repeated on the other, so that no task compares more than ``hot`` words with all of a group.
    """
    rows = written(signatures(words, parts), "signatures")
    large = rows.groupBy("sig").count().where(F.col("count") > hot).select("sig", F.ceil(F.col("count") / hot).cast("int").alias("salts"))
    salted = rows.join(large, "sig", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    one = salted.select(F.col("sig").alias("sig_1"), F.col("word").alias("word_1"), F.col("n").alias("n_1"), F.col("size").alias("size_1"),
                        F.pmod(F.xxhash64("word"), "salts").cast("int").alias("salt_1"))
    two = salted.select(F.col("sig").alias("sig_2"), F.col("word").alias("word_2"), F.col("n").alias("n_2"), F.col("size").alias("size_2"),
                        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_2"))
    shifted = F.abs(F.col("size_1") - F.col("size_2")) <= 1
    verified = (F.col("word_1") < F.col("word_2")) & shifted & (F.levenshtein("word_1", "word_2", 1) == 1)
    same = (F.col("sig_1") == F.col("sig_2")) & (F.col("salt_1") == F.col("salt_2"))
    return one.join(two, same & verified).select("word_1", "n_1", "word_2", "n_2").distinct()


def _roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of words that have a form: the forms are followed by doubling until nothing moves.

    A form occurs RATIO times as often as its word, so chains are as long as the logarithm of the counts at most.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return now
    raise RuntimeError("forms do not end")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: a lower-cased letter run of at least 6 code points that occurs 5 times.

    Only A-Z are lower-cased. A null text has no runs, a null id is hashed as ''. Repeated rows count again. Of several near words with the largest n
    the smallest in code-point order is taken; a form must occur 5 times as often as the word, else form and form_n are null.
    An empty table gives no rows; other columns are not read. ``parts`` and ``hot`` change the work, not the result.
    """
    counted = counted_words(docs, doc_id, text)
    words = written(counted.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)), "words")
    pairs = written(near_words(words, parts, hot), "near-words")
    ends = F.array(
        F.struct(F.col("word_1").alias("word"), F.col("word_2").alias("near"), F.col("n_2").alias("near_n")),
        F.struct(F.col("word_2").alias("word"), F.col("word_1").alias("near"), F.col("n_1").alias("near_n")),
    )
    near = pairs.select(F.explode(ends).alias("e")).groupBy("e.word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("e.near_n")).alias("less"), F.col("e.near").alias("near"))).alias("best")
    )
    often = -F.col("best.less") >= RATIO * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
    )
    joined = written(joined, "forms")
    roots = _roots(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
