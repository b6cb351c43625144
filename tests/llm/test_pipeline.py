"""The stages of the corpus pipeline one after the other, each against what it is given."""

import os

import numpy as np
import pytest

import corpus_pipeline as cp
from candor.llm import language, quality
from candor.llm.common import held_out
from candor.session import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = documents, {}
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == documents.columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = {r["doc_id"]: r["text"] for r in documents.collect()}
    # quality and language: the models' own answers, text by text
    learn = documents.where(~held_out())
    scorer = quality.fit(learn, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out())).scorer()
    expected = {k: t for (k, t), s in zip(whole.items(), scorer(list(whole.values()))) if s >= 0.5}
    assert kept["quality"] == expected
    names, scores = language.fit(learn).predict(list(expected.values()))
    expected = {k: t for (k, t), n, s in zip(expected.items(), names, scores) if n != "und" and s >= cp.LEAST_LANGUAGE_SCORE}
    assert kept["language"] == expected
    # near duplicates: brute force over all pairs
    from test_jaccard import shingles

    sets = {k: shingles(t) for k, t in expected.items()}
    part = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {k: low if p == high else p for k, p in part.items()}
    assert set(kept["jaccard"]) == {k for k, p in part.items() if k == p}
    # packing: every document whole, no sequence over its size
    rows = cp.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(rows["doc_id"]) == set(kept["jaccard"])
    for _, own in rows.sort_values("piece").groupby("doc_id"):
        assert own["start"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (None, "das ist ein Satz", None, "s", 4), (2, "der die das und nicht " * 50, "de", None, 1), (2, "der die das und nicht " * 50, "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), f"odd-{name}")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        empty = written(stage(spark, empty, SF), f"empty-{name}")
    assert empty.count() == 0


def test_no_unlinked_text_is_lost(spark):
    """Repeated and null ids: what stays is one row per group of linked texts, against brute force."""
    from test_jaccard import shingles

    a = " ".join(f"alpha{i}" for i in range(60))
    near = a.replace("alpha59", "omega")
    b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("beta", "gamma"))
    rows = [(1, a), (5, a), (5, b), (9, b), (5, near), (None, c), (None, c), (7, "two words"), (7, "two words"), (7, "Two  WORDS"), (None, b), (8, None), (8, ""), (8, None), (None, " "), (3, "solo word here")]
    rows = [(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in cp.one_of_each_group(spark, docs.repartition(4), SF).collect()]
    sets = {t: shingles(t or "") for _, t, *_ in rows}
    groups = []
    for t in sets:
        if sets[t]:
            touched = [g for g in groups if any(100 * len(sets[t] & sets[o]) >= 75 * len(sets[t] | sets[o]) for o in g)]
            groups = [g for g in groups if g not in touched] + [set().union({t}, *touched)]
    bare = [r for r in rows if not sets[r[1]]]
    assert sorted(map(repr, (r for r in got if not sets[r[1]]))) == sorted(map(repr, bare))
    kept = [r for r in got if sets[r[1]]]
    assert len(kept) == len(groups) and set(kept) <= set(rows)
    for g in groups:
        ids = [r[0] for r in rows if r[1] in g and r[0] is not None]
        (one,) = [r for r in kept if r[1] in g]
        assert one[0] == (min(ids) if ids else None)
    again = [tuple(r) for r in cp.one_of_each_group(spark, docs.repartition(2), SF).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, got))
