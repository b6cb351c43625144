"""Quality and language on held-out rows, and their odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.llm import language, quality, queries
from candor.llm.common import held_out

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
ODD = [(1, None, "x", 9.0), (2, "", None, 1.0), (2, "", None, 1.0), (None, "12 34 !!", "en", 0.5), (4, "ein Satz mit Wörtern " * 20_000, None, None)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang_pred string, SCORE double")


@needs_data
def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op2_quality(spark, SF).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) > 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == r["predicted"] for r in got)
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] == 0 for r in bad) > 0.8 * len(bad)


@needs_data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.97 * len(got)


def model_of(spark):
    good = [(i, f"some fine words number {i} and plain sentences follow here.", "en") for i in range(60)]
    bad = [(i, f"### {i} $$$ *** !!! " * 8, "de") for i in range(60, 120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    return docs, labels


def test_quality_of_odd_rows(spark):
    docs, labels = model_of(spark)
    model = quality.fit(docs, labels)
    got = quality.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}
    by = {}
    for r in got:
        by.setdefault(r["text"], set()).add(r["score"])
    assert by[None] == by[""] and all(len(s) == 1 for s in by.values())
    plain = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert plain[5] > 0.5 > plain[100]


def test_quality_without_labels(spark):
    docs, labels = model_of(spark)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    only_good = quality.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs, only_good).collect()} == {1.0}
    assert quality.score(docs.limit(0), only_good).count() == 0


def test_language_of_odd_rows(spark):
    docs, _ = model_of(spark)
    model = language.fit(docs)
    got = language.identify(odd(spark), model).collect()
    assert len(got) == len(ODD) and set(got[0].asDict()) == {"doc_id", "text", "lang_pred", "score"}
    for r in got:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
        assert 0 <= r["score"] <= 1
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_presence_equals_brute_force():
    texts = ["Abc abc", "", "é ß", "xy" * 40]
    got = language.presence(texts).sum(1).tolist()
    for t, n in zip(texts, got):
        raw = b" " + t.lower().encode() + b" "
        grams = {raw[i : i + k] for k in language.ORDERS for i in range(len(raw) - k + 1)}
        assert len(grams) - 2 <= n <= len(grams)  # hashed places may coincide


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 60)  # 20 languages with 400 texts each would be far more
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k + 3)) % 26) for j in range(9))
    rows = [(i, f"{word(i % 20)} {word(i % 20)[::-1]} {i}", f"l{i % 20}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 20
    got = language.identify(docs, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.95 * len(got)


def test_copies_leave_other_texts_in_the_sample(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(language, "solve", lambda texts, names: held.update(zip(map(bytes, texts), names)) or len(texts))
    copied = spark.range(20_000).selectExpr("id as doc_id", "'lauter gleiche Worte' as text", "'de' as lang")
    others = spark.range(50).selectExpr("id as doc_id", "concat('Text Nummer ', id) as text", "'de' as lang")
    assert language.fit(copied.union(others), sample_rows=40) == 40
    assert len(held) == 40


def test_fits_read_whole_texts(spark):
    head = "the same plain opening words of every text. " * 600  # beyond the former cuts
    tails = ["fine words of a good text follow. ", "### $$$ *** !!! "]
    rows = [(i, head + f"{i} " + tails[i % 2] * 900, ["en", "de"][i % 2], 1 - i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    model = quality.fit(docs, docs.select("doc_id", "quality"))
    got = quality.score(docs, model).collect()
    assert all((r["score"] > 0.5) == (r["quality"] == 1) for r in got)
    assert all((r["score"] > 0.9) or (r["score"] < 0.1) for r in got)
    named = language.identify(docs, language.fit(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in named)


def test_quality_score_against_plain_python(spark):
    """The whole method by hand: dictionaries of all blocks, sizes by block, logistic calibration."""
    import zstandard

    docs, labels = model_of(spark)
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pair = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries]
    long = "some fine words " * 700
    for text in [*list(texts.values())[::17], long, ""]:
        raw = text.encode()
        sizes = [sum(len(c.compress(raw[i : i + quality.BLOCK_BYTES])) for i in range(0, len(raw), quality.BLOCK_BYTES)) for c in pair]
        x = ((sizes[1] - sizes[0]) / (len(raw) + 20) - model.centre[0]) / model.spread[0]
        wanted = 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * x)))
        assert model.scorer()([text])[0] == pytest.approx(wanted, abs=0.02)


def test_quality_dictionaries_see_whole_texts(spark):
    """A passage at the very end of long texts is learned; few blocks are a dictionary by themselves."""
    tail = "zebra quagga okapi " * 20
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(str(n) for n in rng.integers(0, 10**9, 3_000)) + (tail if i < 8 else "")) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert b"quagga" in model.dictionaries[0] and b"quagga" not in model.dictionaries[1]
    small = quality.dictionary([b"a few bytes", b"and more"])
    assert small == b"a few bytes\nand more"
    bounded = quality.fit(docs, labels, sample_blocks=5)
    assert max(len(d) for d in bounded.dictionaries) <= 5 * quality.BLOCK_BYTES + 4


def test_language_against_plain_python(spark):
    """Landmarks, Nystroem map and ridge regression worked out once more from the definition."""
    rng = np.random.default_rng(4)
    words = {"en": ["the", "house", "and", "with", "this"], "de": ["der", "hausen", "und", "mitte", "dieser"], "fr": ["une", "maison", "avec", "cette", "elle"]}
    rows = [(" ".join(rng.choice(w, 12)) + f" {i}", lang) for lang, w in words.items() for i in range(30)]
    bits = np.array([np.packbits(language.presence([t])[0]) for t, _ in rows])
    names = [lang for _, lang in rows]
    model = language.solve(bits, names, landmarks=8)
    sets = [set(np.flatnonzero(language.presence([t])[0])) for t, _ in rows]
    cosine = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    langs = sorted(words)
    marks = [i for lang in langs for i in [k for k, n in enumerate(names) if n == lang][:8]]
    inner = np.array([[cosine(sets[i], sets[j]) for j in marks] for i in marks])
    kernel = np.array([[cosine(s, sets[j]) for j in marks] for s in sets])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values.max()
    mapped = kernel @ (vectors[:, good] / np.sqrt(values[good]))
    weight = np.array([1 / names.count(n) for n in names])
    target = np.array([[1.0 if n == lang else -1.0 for lang in langs] for n in names])
    left = (mapped * weight[:, None]).T @ mapped + language.RIDGE * np.eye(mapped.shape[1])
    scores = mapped @ np.linalg.solve(left, (mapped * weight[:, None]).T @ target)
    assert np.allclose(language.raw_scores(np.array([language.presence([t])[0] for t, _ in rows]), model.weights), scores, atol=1e-3)
    found, share = model.predict([t for t, _ in rows])
    assert found == [langs[i] for i in scores.argmax(1)]
    assert np.allclose(share, language.softmax(scores * model.sharpness).max(1), atol=1e-2)
