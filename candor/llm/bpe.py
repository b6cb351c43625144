"""Byte-level BPE encoding and decoding in batched numpy merge rounds (operator 5).

Words of a whole batch of texts are found with array operations on code points;
each distinct word is merged once. All their symbols lie in one flat array. A
round looks the changed neighbour pairs up by binary search over the sorted pair
keys of the vocabulary, takes the lowest rank of every word and merges it there;
finished words leave the array.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import Shared, map_texts, without

# fixed values: the Unicode property White_Space
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: suffixes that the pre-tokenizer splits off after an apostrophe
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
NO_RANK = np.iinfo(np.int32).max
WINDOW = 1 << 20  # characters of a long text that are worked on at once
CACHED_WORDS = 3 << 18  # distinct words that a task remembers


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    found[list(WHITE_SPACE)] = SPACE
    return found


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class ByteLevelBPE:
    """Tables of one vocabulary file; instances travel to the tasks in a broadcast."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab_size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        unchar, vocab = byte_characters(), model["vocab"]
        self.first = np.zeros(256, np.int32)
        for c, b in unchar.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.vocab_size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        grid = np.indices((256, 256)).reshape(2, -1).T.ravel()  # every pair of bytes as a word
        self.byte_ranks = self.pair_ranks(self.first[grid], np.arange(1 << 17) // 2, np.arange(0, 1 << 17, 2))
        tokens = {i: bytes(unchar[c] for c in s) for s, i in vocab.items()}
        tokens |= {i: s.encode() for s, i in self.special.items()}
        spelled = [tokens.get(i, b"") for i in range(self.vocab_size)]
        self.token_length = np.array([len(t) for t in spelled], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.classes = character_classes()
        self.salt = np.random.default_rng(7).integers(0, 2**64, (64, 256), np.uint64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    @classmethod
    def from_file(cls, path: str) -> ByteLevelBPE:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def forget(self) -> None:
        """Empty the word cache."""
        self.known = np.zeros(0, np.uint64)  # sorted word hashes
        self.known_start = np.zeros(0, np.int64)
        self.known_length = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.uint32)

    # -- words ---------------------------------------------------------------

    def word_starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Mask of the code points that start a word; ``begins`` are starts of separate texts."""
        kind = self.classes[codes]
        start = np.empty(len(codes), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[begins] = True
        inner = np.ones(len(codes), bool)  # has a predecessor in the same text
        inner[begins] = False
        # the last white space before a word goes with it if it is a blank, else stands alone
        after = np.flatnonzero(inner[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True
        start[after] = codes[after - 1] != 0x20
        # 's, 't, 're, ... where the apostrophe starts a word of its own
        mark = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & inner[1:] & (kind[1:] == LETTER))
        for suffix in SUFFIXES:
            hit = mark[mark + len(suffix) < len(codes)]
            for k, c in enumerate(suffix, 1):
                hit = hit[(codes[hit + k] == ord(c)) & inner[hit + k]]
            start[hit + 1] = False
            rest = hit + 1 + len(suffix)
            start[rest[rest < len(codes)]] = True
        return start

    def hash_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """64-bit tabulation hash of each byte range; ranges cover ``data``."""
        place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        term = self.salt[place & 63, data]
        if len(lengths) and lengths.max() > 64:
            term *= (2 * (place >> 6) + 1).astype(np.uint64)
        return np.add.reduceat(term, starts)

    def merge_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) of words that lie one after the other in ``data``."""
        symbol = self.first[data]
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(data), NO_RANK, np.int32)
        rank[:-1] = self.byte_ranks[data[:-1].astype(np.int32) * 256 + data[1:]]
        rank[np.cumsum(lengths) - 1] = NO_RANK
        done_ids, done_words = [], []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            over = best == NO_RANK
            if over.any():
                done_ids.append(symbol[over])
                done_words.append(word[over])
                symbol, word, rank, best = symbol[~over], word[~over], rank[~over], best[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            # of overlapping places (aaa) every other one counts, from the left
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[place % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))  # as many symbols before each place have gone
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            touched = np.zeros(len(symbol), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            rank[changed] = self.pair_ranks(symbol, word, changed)
        ids, owner = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (done_ids, done_words))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=len(lengths))

    def pair_ranks(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place; none at the end of a word."""
        rank = np.full(len(at), NO_RANK, np.int32)
        follows = np.minimum(at + 1, len(symbol) - 1)
        inside = np.flatnonzero((word[at] == word[follows]) & (follows > at))
        key = symbol[at[inside]] * np.int64(self.vocab_size) + symbol[follows[inside]]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        rank[inside] = np.where(self.pair_keys[found] == key, self.ranks[found], NO_RANK)
        return rank

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) in ``known_ids`` of each word's ids."""
        hashes = self.hash_words(data, starts, lengths)
        distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.forget()
        new = np.ones(len(distinct), bool)
        if len(self.known):
            found = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = self.known[found] != distinct
        if new.any():
            s, n = starts[sample[new]], lengths[sample[new]]
            ids, counts = self.merge_words(data[ranges(s, n)], n)
            keys = np.concatenate([self.known, distinct[new]])
            order = np.argsort(keys, kind="stable")
            begin = np.cumsum(counts) - counts + len(self.known_ids)
            self.known = keys[order]
            self.known_start = np.concatenate([self.known_start, begin])[order]
            self.known_length = np.concatenate([self.known_length, counts])[order]
            self.known_ids = np.concatenate([self.known_ids, ids])
        found = np.searchsorted(self.known, distinct)[place]
        return self.known_start[found], self.known_length[found]

    # -- texts ---------------------------------------------------------------

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of texts that are not empty and hold no special token."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        start = np.flatnonzero(self.word_starts(codes, begins))
        width = np.ones(len(codes), np.int8)
        for limit in (0x80, 0x800, 0x10000):
            width += codes >= limit
        offset = np.cumsum(width, dtype=np.int64) - width
        data = np.frombuffer(joined.encode(), np.uint8)
        starts = offset[start]
        lengths = np.diff(np.r_[starts, len(data)])
        at, count = self.lookup(data, starts, lengths)
        ids = self.known_ids[ranges(at, count)]
        first_word = np.searchsorted(start, begins)
        return ids, np.add.reduceat(count, first_word)

    def parts(self, text: str):
        """Pieces of a text that are encoded on their own, special tokens as their id."""
        for piece in self.split_special.split(text) if self.split_special else [text]:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                yield from windows(piece)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text); a null text has none."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in self.parts(text or ""):
                pieces.append(piece)
                owner.append(i)
        held, ids, counts = [], [], []

        def work():
            plain = [p for p in held if isinstance(p, str)]
            found, number = self.encode_plain(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            if len(plain) == len(held):
                ids.append(found)
                counts.append(number)
            else:
                cut = iter(np.split(found, np.cumsum(number)[:-1]))
                each = [next(cut) if isinstance(p, str) else np.array([p], np.uint32) for p in held]
                ids.extend(each)
                counts.append(np.array([len(x) for x in each]))
            held.clear()

        size = 0
        for p in pieces:
            held.append(p)
            size += len(p) if isinstance(p, str) else 1
            if size >= 2 * WINDOW:
                work()
                size = 0
        if held:
            work()
        total = np.zeros(len(texts), np.int64)
        if counts:
            np.add.at(total, owner, np.concatenate(counts))
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Text of each run of ids; ids outside the vocabulary stand for nothing."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < self.vocab_size)
        safe = np.where(known, ids, 0)
        length = np.where(known, self.token_length[safe], 0)
        data = self.token_bytes[ranges(self.token_start[safe], length)].tobytes()
        edges = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]


def windows(text: str, most: int = WINDOW):
    """Cut a long text where white space follows a word: words on both sides stay the same."""
    start = 0
    cut = re.compile(r"(?<=\S)[ \n]")
    while len(text) - start > most:
        found = cut.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]


def shared(spark: SparkSession, tokenizer: str):
    """The tables of a vocabulary file in a broadcast (a few MB, bounded by the file)."""
    return Shared(spark, ByteLevelBPE.from_file(tokenizer))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array column ``ids``.

    Special tokens of the vocabulary that stand in a text become their id, as in
    the file's own library; none are added. Null and empty texts have an empty
    array. Texts of any length are worked on in windows. Repeated rows stay; a
    column named like ``ids`` is replaced.
    """
    table = shared(df.sparkSession, tokenizer)

    def make():
        bpe = table.value

        def work(texts):
            return [lists(*bpe.encode(texts))]

        return work

    return map_texts(df, text, make, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an id array as column ``text``, special tokens included.

    A null array gives null, an empty one the empty text; null ids and ids that
    the vocabulary lacks stand for nothing; bytes that are no UTF-8 become U+FFFD.
    """
    table = shared(df.sparkSession, tokenizer)
    rows = without(df, [text]) if text.lower() != ids.lower() else df
    out = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    names = [f.name for f in out.fields[:-1]]

    def task(batches):
        bpe = table.value
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, max(batch.num_rows, 1), 512)):
                column = part.column(part.schema.get_field_index(ids))
                flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
                made = pa.array(bpe.decode(flat, sizes), pa.string(), mask=np.asarray(column.is_null()))
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*old, made], names=[*names, text])

    return rows.mapInArrow(task, out)


def id_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
