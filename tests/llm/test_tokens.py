"""BPE, token counts and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candor.llm import bpe, packing, token_count
from candor.session import written

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(5)
ALPHABETS = (" \n\t'stremvld!?.,09aA é日½🙂　\x1f▁", "the an in re ation", " e", "'lveSd ", "abcdefgh")
TEXTS = [
    None, "", " ", "   ", "\n\n", "it's we'll I'd 'S 're'll''s\n's \n 's", "a<|endoftext|> b<|endoftext|>", "<s>a</s><unk>",
    "aaaaaaaaaaaaaaaa", "日本語 テスト 123４", "e\u0301 \u00a0x", "\x00\x1c\x85", "1²½ Ⅷ", "🙂🙂 🙂", "x" * 5000, " " * 3000,
    "longer words thanordinary " * 3000, "▁▁a",
] + ["".join(rng.choice(a) for _ in range(rng.randrange(0, 50))) for a in ALPHABETS for _ in range(150)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteLevelBPE.from_file(BYTE)


def docs(spark):
    rows = [(i, t, "ids", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "   ", "x", 1), (3, "   ", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, IDS string, n_tokens int").repartition(3)


def test_ids_equal_the_library(encoder, tokenizer):
    ids, counts = encoder.encode(TEXTS)
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected
    assert encoder.decode(ids, counts) == [tokenizer.decode(e, skip_special_tokens=False) for e in expected]


def test_every_character_class(encoder, tokenizer):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for e in tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_small_windows_and_cache_give_the_same(encoder, monkeypatch):
    text = "some words, and\nothers  too " * 400
    whole = encoder.encode([text])[0].tolist()
    monkeypatch.setattr(bpe, "WINDOW", 64)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 1)
    monkeypatch.setattr(bpe.windows, "__defaults__", (64,))
    assert encoder.encode([text])[0].tolist() == whole


def test_encode_and_decode_frames(spark, tokenizer):
    df = bpe.decode(bpe.encode(docs(spark), BYTE), BYTE)
    assert df.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    got = df.collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert list(r["ids"]) == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([([70, None, 10**6, -1],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, BYTE).orderBy(F.size("ids")).collect()] == [None, "", "g"]


def test_token_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in token_count.count_tokens(docs(spark), PIECE).collect():
        assert r["n_tokens"] == len(sp.encode(r["text"] or ""))
        assert r["n_bytes"] == len((r["text"] or "").encode())


def test_counts_do_not_depend_on_chunks_or_kept_states(monkeypatch):
    texts = [t for t in TEXTS if t] + ["日本語" * 700, "thereinationsg" * 500]
    expected = token_count.load(PIECE).count(texts).tolist()
    monkeypatch.setattr(token_count, "CHUNK", 7)
    monkeypatch.setattr(token_count, "MOST_CELLS", 1 << 12)
    small = token_count.load(PIECE)
    assert [int(small.count([t])[0]) for t in texts] == expected
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert expected == [len(x) for x in sp.encode(texts)]


def test_pieces_and_sequences(spark, tokenizer):
    df = packing.pack(packing.pieces(docs(spark), BYTE, max_tokens=64, with_ids=True), capacity=64)
    rows = [r.asDict() for r in df.collect()]
    by_doc = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == len(r["ids"])
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue  # stands three times
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        assert all(r["length"] == 64 for r in own[1:])
    assert len(by_doc[3]) == 3 and len(by_doc[None]) == 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and sum(s[-1]) <= 64
    assert len(sequences) <= 1.1 * sum(r["length"] for r in rows) / 64 + 8


def test_the_fullest_closes_first():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (4, 7, 6, 3, 5)] == [(0, 0), (1, 0), (0, 4), (1, 7), (2, 0)]
    bins = packing.BestFit(10, 2, 0)
    bins.place(8), bins.place(6), bins.place(7)  # one more than may be open: the one of 8 closes
    assert bins.place(2) == (2, 7) and bins.place(4) == (1, 6)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 0, 5), (3, 4, 5)], "doc_id long, length long, offset int")
    got = {r["doc_id"]: (r["sequence_id"] is None, r["offset"]) for r in packing.pack(df, capacity=8).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0)}
    with pytest.raises(Exception, match="a piece of 9 tokens"):
        packing.pack(spark.createDataFrame([(9,)], "length long"), capacity=8).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).count() == 0
    assert token_count.count_tokens(none, PIECE).count() == 0
    assert packing.pack(packing.pieces(none, BYTE)).count() == 0


def test_equal_rows_are_packed_by_many_tasks(spark):
    rows = spark.range(4_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(100).cast("long").alias("length"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the partitions are far below what Spark would join here
    try:
        got = written(packing.pack(rows.repartition(4)), "packed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.select((F.col("sequence_id") / (1 << packing.TASK_BITS)).cast("int")).distinct().count() > 1
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert got.select("sequence_id").distinct().count() <= 1.05 * 4_000 / 10


def test_counts_of_long_texts_without_blanks():
    """Chunks of texts without ASCII separators run side by side: few steps one after the other, and the library's counts."""
    transducer = token_count.load(PIECE)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    draw = random.Random(3)
    letters = "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ何でも薄暗いじめじめした所で"
    texts = [
        "".join(draw.choice(letters) for _ in range(20_000)),
        "a" * 30_000,
        "ab" * 20_000 + "é",
        "".join(draw.choice(["é", "日本", "abc", " ", "\n", "🙂", "▁", "的"]) for _ in range(20_000)),
        "".join(draw.choice("etaoin") for _ in range(10_000)),
    ]
    steps = []
    plain = transducer.run

    def seen(data, begin, end, state):
        steps.append(int((end - begin).max()) if len(begin) else 0)
        return plain(data, begin, end, state)

    transducer.run = seen
    assert transducer.count(texts).tolist() == [len(library.encode(t)) for t in texts]
    assert sum(steps) <= 40 * token_count.CHUNK  # some 400 chunks of all texts, one after the other before
    assert transducer.count([None, "", "猫", texts[1]]).tolist() == [0, 0, len(library.encode("猫")), len(library.encode(texts[1]))]
