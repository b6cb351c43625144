import re
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from candor.functions import scoring
from candor.functions import text as tx

# fixed values: the listed phrases and words
AI_PHRASES = (
    "as an ai",
    "i'm an ai",
    "as a language model",
    "i don't have personal",
    "i can't browse",
    "i don't have access",
    "as of my last update",
    "i'm sorry, but i",
    "i understand you're looking",
    "it's important to note",
    "please note that",
    "i'd be happy to help",
    "furthermore",
    "moreover",
    "additionally",
    "in conclusion",
)
FORMAL_WORDS = ("utilize", "facilitate", "implement", "furthermore", "therefore", "however")

TEXTS = [
    "A. B.",
    "no stop",
    "word",
    "Hello there! How are you? I am fine, thanks.",
    "As an AI language model, I can help. Furthermore, it's important to note that we utilize tools.",
    "same same same same other words here.",
    "One.  two\tthree\nfour.  Five six! ÉCOLE ünd ²³ 42",
    " ".join(f"Sentence number {i} is here." for i in range(25)),
    ". ".join(f"Real sentence {i}" for i in range(30)),
    "   ",
    "a" * 300 + " " + "b" * 3,
    "short. " + "long " * 40 + ". tiny.",
]


def plain_features(text):
    words = text.split()
    pieces = re.split(r"[.!?]+", text)
    sizes = [len(p.split()) for p in pieces if p.strip()]
    low = text.lower()
    counts = {}
    for w in low.split():
        if len(w) > 3:
            counts[w] = counts.get(w, 0) + 1
    caps = sum(1 for p in pieces if p.strip() and p.strip()[0].isupper())
    n = len(words)
    out = {
        "char_count": len(text),
        "word_count": n,
        "sentence_count": len(pieces),
        "exclamation_ratio": text.count("!") / len(text),
        "period_ratio": text.count(".") / len(text),
        "uppercase_ratio": sum(c.isupper() for c in text) / len(text),
        "digit_ratio": sum(c.isdigit() for c in text) / len(text),
        "avg_word_length": statistics.fmean(map(len, words)) if words else None,
        "word_length_std": statistics.pstdev(map(len, words)) if words else None,
        "avg_sentence_length": statistics.fmean(sizes) if sizes else None,
        "sentence_length_std": statistics.pstdev(sizes) if sizes else None,
        "ai_phrase_density": sum(p in low for p in AI_PHRASES) / n if n else 0.0,
        "formal_language_density": sum(p in low for p in FORMAL_WORDS) / n if n else 0.0,
        "repetition_score": max(counts.values()) / n if n >= 2 and counts else 0.0,
        "perfect_punctuation": float(len(pieces) >= 2 and caps / len(pieces) > 0.95),
    }
    return out


def test_features_match_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    rows = tx.with_text_features(df).orderBy("id").collect()
    for row, text in zip(rows, TEXTS):
        for name, value in plain_features(text).items():
            got = row["features"][name]
            assert got == pytest.approx(value, abs=1e-9) if value is not None else got is None, (name, text[:30])


def test_empty_and_missing_text_have_no_features_and_neutral_score(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id int, content string")
    assert [r["features"] for r in tx.with_text_features(df).collect()] == [None, None]
    for r in scoring.score_text(df).collect():
        assert (r["authenticity_score"], r["confidence_score"], r["explanation"]) == (0.5, 0.5, "No clear indicators")


def test_character_classes_equal_python_for_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in points if c < 0x20000], "c int, s string")
    got = df.select(
        "c",
        F.col("s").rlike(tx.DIGIT).alias("digit"),
        F.col("s").rlike("^" + tx.WHITESPACE + "$").alias("space"),
        F.col("s").rlike(tx.UPPERCASE).alias("upper"),
        F.col("s").rlike(r"\p{Cn}").alias("unknown"),
    ).collect()
    # code points that either side's Unicode version does not assign yet are left out
    known = [r for r in got if not r["unknown"] and unicodedata.category(chr(r["c"])) != "Cn"]
    assert len(known) > 80_000
    for name, test in (("space", str.isspace), ("digit", str.isdigit), ("upper", str.isupper)):
        assert [hex(r["c"]) for r in known if r[name] != test(chr(r["c"]))] == [], name


def test_rules_in_order(spark):
    texts = [
        (1, "As an AI model I say: moreover the moreover moreover thing"),
        (2, "Plain short text without anything special in it at all, really nothing to see"),
    ]
    rows = {r["content_id"]: r for r in scoring.score_text(spark.createDataFrame(texts, "id int, content string")).collect()}
    # phrase rule and repetition rule (3 of 10 words); reading ease may add or take 0.1
    assert rows["1"]["explanation"].startswith("Contains AI-specific phrases; High repetition patterns")
    assert rows["1"]["confidence_score"] == pytest.approx(0.8)
    assert rows["2"]["explanation"] == "No clear indicators"
    assert all(0 <= r["authenticity_score"] <= 1 for r in rows.values())


def test_scoring_plan_is_jvm_only_and_narrow(spark):
    df = spark.createDataFrame([(1, "x")], "id int, content string")
    plan = scoring.score_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_tag_shares_small_and_large_lexicon_agree(spark, monkeypatch):
    df = spark.createDataFrame([("a", "the cat runs the race"), ("b", "blue")], "id string, content string")
    lexicon = spark.createDataFrame([("cat", "NOUN"), ("race", "NOUN"), ("runs", "VERB"), ("blue", "ADJ")], "word string, pos string")
    small = sorted(tx.tag_shares(df, lexicon).collect())
    assert small[0]["noun_ratio"] == pytest.approx(0.4) and small[1]["adj_ratio"] == 1.0
    monkeypatch.setattr(tx.config, "BROADCAST_ROWS", 1)
    assert sorted(tx.tag_shares(df, lexicon).collect()) == small


def test_bands_and_predictions(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.31,), (0.3,), (0.5,)], "s double")
    rows = df.select(scoring.score_band(F.col("s")).alias("b"), scoring.predicted_source(F.col("s")).alias("p")).collect()
    assert [r["b"] for r in rows] == ["Likely Human", "Uncertain", "Uncertain", "Likely AI-Generated", "Uncertain"]
    assert [r["p"] for r in rows] == ["human", "human", "ai_generated", "ai_generated", "ai_generated"]


def test_quick_classes_hold_the_same_characters(spark):
    seen = spark.createDataFrame([(chr(i),) for i in range(0x20000) if not 0xD800 <= i < 0xE000], "c string").cache()
    for quick, plain in ((tx._BLANK, tx.WHITESPACE), (tx._NUMERAL, tx.DIGIT)):
        assert seen.where(F.col("c").rlike(quick)).count() > 20
        assert seen.where(F.col("c").rlike(quick) != F.col("c").rlike(plain)).count() == 0


def test_longest_run_and_moments_build_no_struct_per_word(spark):
    df = spark.createDataFrame([(["b", "a", "b", "a", "b"],), ([],), (["x"],)], "w array<string>")
    lengths = F.transform("w", F.length)
    got = df.select(tx.top_frequency(F.col("w")).alias("top"), tx._moments(lengths).alias("m")).collect()
    assert [r["top"] for r in got] == [3, 0, 1]
    assert [tuple(r["m"]) for r in got] == [(5, 5, 5), (0, 0, 0), (1, 1, 1)]
    plan = df.select(tx._moments(lengths).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and "lambdafunction(struct" not in plan
