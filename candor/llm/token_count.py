"""Token counts by a compiled finite-state transducer (operator 6).

A merge vocabulary splits a text in just one way, and whether two neighbouring
tokens may stand together depends on these two alone. So the last token of every
prefix follows from a bounded window: the starts from which the text read so far
may still grow into a token, each with the token that ends there. That window is
a state; reading a character leads to the next one and changes the number of
tokens by a fixed amount, which annotates the transition. States and transitions
over bytes are compiled when they are first met and kept in dense tables.

Texts of a batch are cut into chunks of equal size. Where two neighbouring
characters stand together in no token, the state no longer depends on what came
before. A chunk's state map is therefore a head up to the first such place and a
constant after it: all tails run side by side, and all heads as well, each from the state that the
bytes before its chunk lead to by themselves. The scan compares these entry states with the end states of the
predecessors and runs anew only where they differ, until all chunks fit together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import Shared, map_texts

BLANK = "▁"  # stands for a blank in the vocabulary
CHUNK = 512  # bytes
WARM = 96  # bytes before a chunk that its entry state is first worked out from
MOST_CELLS = 1 << 25  # of the tables (5 bytes each); beyond, they are compiled anew
ROOT = 0


def _pair(before, after):
    """One number for two neighbouring code points."""
    return before * (1 << 21) + after


class CountingTransducer:
    """Lazily compiled transducer of one vocabulary (pieces with their scores)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {p[:n] for p in scores for n in range(len(p) + 1)}
        self.inside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        letters = {p for p in scores if len(p) == 1}
        if missing := {c for p in scores for c in p} - letters:
            raise ValueError(f"characters that are no piece of their own: {sorted(missing)[:5]}")
        # neighbouring ASCII bytes that no token holds next to each other
        self.apart = np.zeros((256, 256), bool)
        shown = [BLANK if b == 0x20 else chr(b) for b in range(128)]
        for a in range(128):
            for b in range(128):
                self.apart[a, b] = shown[a] + shown[b] not in self.inside
        self.apart = self.apart.ravel()
        self.joined = np.sort(np.array([_pair(ord(p[0]), ord(p[1])) for p in self.inside if len(p) == 2], np.int64))
        self.stands: dict[tuple[str | None, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the compiled states; they are compiled again when needed."""
        root = ("", ((0, None, 0),))
        self.keys: list = [root]
        self.ids = {root: ROOT}
        self.column = np.full(256, -1, np.int32)
        self.columns = 0
        self.following = np.full((1024, 32), -1, np.int32)
        self.change = np.zeros((1024, 32), np.int8)
        self.begin, _ = self.read(root, BLANK)

    def split(self, text: str) -> list[str]:
        """Pieces of a short string by best-first merging."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, before: str | None, piece: str) -> bool:
        known = self.stands.get((before, piece))
        if known is None:
            if before is None:
                known = self.split(piece) == [piece]
            else:
                known = self.split(before + piece) == [before, piece]
            if len(self.stands) > 1 << 20:
                self.stands.clear()
            self.stands[before, piece] = known
        return known

    def state(self, key) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if at >= len(self.following):
                self.following = np.concatenate([self.following, np.full_like(self.following, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return at

    def read(self, key, char: str) -> tuple[int, int]:
        """(next state, change of the count) after one whole character."""
        text, starts = key
        char = BLANK if char == " " else char
        if char not in self.scores:  # its bytes are tokens
            return ROOT, len(char.encode())
        if text and text[-1] + char not in self.inside:
            text, starts = self.keys[ROOT]
        grown = text + char
        token, tokens = None, 0  # the last token of the text so far, and how many more it has now
        for length, before, newer in starts:  # newer: tokens since this start
            piece = grown[len(text) - length :]
            if piece in self.scores and self.may_follow(before, piece):
                token, tokens = piece, 1 - newer
        if token is None:
            raise ValueError(f"the vocabulary has no way to split {grown!r}")
        alive = [
            (length + 1, before, newer + tokens)
            for length, before, newer in starts
            if grown[len(text) - length :] in self.prefixes
        ]
        alive.append((0, token, 0))
        return self.state((grown[len(grown) - alive[0][0] :], tuple(alive))), tokens

    def step(self, state: int, byte: int) -> tuple[int, int]:
        key = self.keys[state]
        base, held = (key[1], key[2]) if key[0] is None else (state, b"")
        held += bytes([byte])
        lead = held[0]
        if len(held) < 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0):
            return self.state((None, base, held)), 0
        return self.read(self.keys[base], held.decode("utf-8", "replace"))

    def compile(self, states: np.ndarray, values: np.ndarray) -> None:
        """Fill in the transitions of these states with these bytes."""
        for byte in np.unique(values[self.column[values] < 0]).tolist():
            self.column[byte] = self.columns
            self.columns += 1
            if self.columns > self.following.shape[1]:
                self.following = np.concatenate([self.following, np.full_like(self.following, -1)], axis=1)
                self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)
        for code in np.unique(states.astype(np.int64) * 256 + values).tolist():
            state, byte = divmod(code, 256)
            column = self.column[byte]
            if self.following[state, column] < 0:
                target, change = self.step(state, byte)
                self.following[state, column] = target
                self.change[state, column] = change

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end state, change of the count) of every byte range, all of them side by side."""
        order = np.argsort(begin - end, kind="stable")  # the longest first
        at, length, now = begin[order], (end - begin)[order], state[order].astype(np.int32)
        total = np.zeros(len(order), np.int64)
        reach = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for p, n in enumerate(reach.tolist()):
            byte = data[at[:n] + p]
            column = self.column[byte]
            target = self.following[now[:n], column]
            new = (target < 0) | (column < 0)
            if new.any():
                self.compile(now[:n][new], byte[new])
                column = self.column[byte]
                target = self.following[now[:n], column]
            total[:n] += self.change[now[:n], column]
            now[:n] = target
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def places_apart(self, data: np.ndarray) -> np.ndarray:
        """Byte places whose character no token holds together with the one before it, in order."""
        free = np.flatnonzero(self.apart[data[:-1].astype(np.int32) * 256 + data[1:]]) + 1
        if not (data >= 0x80).any():
            return free
        start = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code[code == 0x20] = ord(BLANK)
        wide = np.flatnonzero((code[1:] > 127) | (code[:-1] > 127)) + 1
        pair = _pair(code[wide - 1], code[wide])
        at = np.minimum(np.searchsorted(self.joined, pair), max(len(self.joined) - 1, 0))
        held = self.joined[at] == pair if len(self.joined) else np.zeros(len(pair), bool)
        return np.union1d(free, start[wide[~held]])

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of every text; none for a null or empty one."""
        if len(self.keys) * self.following.shape[1] > MOST_CELLS:
            self.forget()
        raw = [(t or "").encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        result = (sizes > 0).astype(np.int64)  # the blank put before each text
        if not len(data):
            return result
        first = np.cumsum(sizes) - sizes
        # chunks of every text
        number = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), number)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        begin = first[owner] + rank * CHUNK
        end = np.minimum(begin + CHUNK, first[owner] + sizes[owner])
        # the first place of each chunk from which the state is known
        free = self.places_apart(data)
        found = np.searchsorted(free, begin)
        anchor = np.where(found < len(free), free[np.minimum(found, max(len(free) - 1, 0))] if len(free) else 0, len(data))
        opening = rank == 0
        known = opening | (anchor < end)
        head_end = np.where(opening, begin, np.where(known, anchor, end))
        tails = np.flatnonzero(known)
        leaving = np.full(len(owner), -1, np.int64)
        counted = np.zeros(len(owner), np.int64)
        leaving[tails], counted[tails] = self.run(
            data, head_end[tails], end[tails], np.where(opening[tails], self.begin, ROOT)
        )
        # heads: entry states by the bytes before, then by the scan wherever a predecessor ends in another state
        heads = np.flatnonzero(~opening & (head_end > begin))
        ahead = begin[heads]
        entry, _ = self.run(data, np.maximum(ahead - WARM, first[owner[heads]]), ahead, np.full(len(heads), ROOT))
        passing = ~known[heads]  # their end state is that of the chunk
        more = np.zeros(len(heads), np.int64)
        stale = np.arange(len(heads))
        mapped: dict[tuple[bytes, int], tuple[int, int]] = {}  # parts of the heads' state maps, by their bytes
        while len(stale):
            keys = [(data[ahead[i] : head_end[heads[i]]].tobytes(), int(entry[i])) for i in stale.tolist()]
            fresh = {k: i for k, i in zip(keys, stale.tolist()) if k not in mapped}
            if fresh:
                rows = np.fromiter(fresh.values(), np.int64, len(fresh))
                ends, counts = self.run(data, ahead[rows], head_end[heads[rows]], entry[rows])
                mapped.update(zip(fresh, zip(ends.tolist(), counts.tolist())))
            out, more[stale] = np.array([mapped[k] for k in keys], np.int64).T
            leaving[heads[stale][passing[stale]]] = out[passing[stale]]
            before = leaving[heads - 1]
            stale = np.flatnonzero(entry != before)
            entry = before.copy()
        counted[heads] += more
        np.add.at(result, owner, counted)
        return result


def load(model: str) -> CountingTransducer:
    """The transducer of a sentencepiece BPE model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    probe = "  Aﬁ é "
    if sp.decode(sp.encode(probe)) != probe or not sp.is_byte(sp.piece_to_id("<0x00>")):
        raise ValueError("only models without normalisation and with byte fallback can be compiled")
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return CountingTransducer({sp.id_to_piece(i): sp.get_score(i) for i in plain})


def shared(spark: SparkSession, model: str):
    """The vocabulary in a broadcast (about 1 MB, bounded by the model file)."""
    return Shared(spark, load(model))


def count_tokens(df: DataFrame, model: str, text: str = "text", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """Add the number of UTF-8 bytes and of tokens of every whole text.

    Null and empty texts count 0 and 0. Strings that look like control tokens are
    ordinary text. Repeated rows stay; columns named like the new ones are replaced.
    """
    table = shared(df.sparkSession, model)

    def make():
        transducer = table.value
        return lambda texts: [transducer.count(texts)]

    sized = df.withColumn(n_bytes, F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long"))
    return map_texts(sized, text, make, [T.StructField(n_tokens, T.LongType(), False)])
