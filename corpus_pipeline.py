"""From raw documents to packed training sequences: each stage is one operator of ``candor.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import jaccard, language, packing, quality
from candor.llm.common import held_out, table
from candor.llm.queries import BYTE_BPE
from candor.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.5  # documents below fit none of the learned languages


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones (score 0.5 or more).

    The text alone decides: repeated rows go or stay together, and a null text is judged as an empty one.
    """
    known = table(spark, sf_dir, "documents").where(~held_out())
    model = quality.fit(known, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model, out="_score").where("_score >= 0.5").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that fit one of the learned languages; null texts and texts without letters go, repeated rows stay."""
    model = language.fit(table(spark, sf_dir, "documents").where(~held_out()))
    found = language.identify(docs, model, lang="_lang", score="_score")
    kept = found.where((F.col("_lang") != language.UNDETERMINED) & (F.col("_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; ids decide nothing else.

    Texts of one id that do not link are groups of their own, null ids come last, equal rows leave one, and
    rows without words stay as they are.
    """
    return jaccard.one_of_each_group(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences; every row is packed, null texts as empty ones."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(BYTE_BPE)))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("jaccard", one_of_each_group),
    ("packing", packed),
]

#: Models and tokenizers cannot be written in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
