"""Source divergence against plain Python, with runs, chunks and merges forced to be small."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from candor.llm import source_divergence as sd

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """rows: (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["Été", "ÉTÉ", "straße", "日本語", "A"]
    langs, sources = ["en", "de", None], ["s0", "s1", "s2", "S1", "", None, "ü"]
    return [(" ".join(rng.choice(words, rng.integers(0, 25))) + "!1", langs[i % 3] if i % 7 else "en", sources[int(rng.integers(0, 7)) if i % 3 else 0]) for i in range(n)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in sd.divergence(df.repartition(3), **options).collect())


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"block": 50, "shards": 5, "fan_in": 3, "merge": 40},  # many runs, several levels of merging
    ],
)
def test_against_plain_python(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(sd, "CHUNK_POSTINGS", 7)
    rows = made(400)
    assert run(spark, rows, least_documents=6, top=10, **options) == plain(rows, 6, 10)


def test_tiles_of_sources(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(sd, "TILE_TERMS", 10)
    rows = made(300, 2)
    assert run(spark, rows, least_documents=4, top=5) == plain(rows, 4, 5)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("1 2 3", "en", "b"), ("x", "fr", "only"), ("Word " * 30, "en", "c"), ("Word", "en", "c"), ("Word", "en", "c")]
    assert run(spark, rows, least_documents=2) == plain(rows, 2, 50)
    assert run(spark, rows, least_documents=30) == plain(rows, 30, 50)  # no kept term: pairs of value 0
    assert run(spark, [], least_documents=2) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a b", "en", "s", 1, "y"), ("b c", "en", "t", 2, "z")], "text string, lang string, source string, term long, ITEM string")
    got = sorted(tuple(r) for r in sd.divergence(df, least_documents=1).collect())
    assert got == plain([("a b", "en", "s"), ("b c", "en", "t")], 1, 50)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Ab cdé " * 5_000) + "x" * 900 + " end"
    whole = sd.terms_of(text)
    monkeypatch.setattr(sd, "WINDOW", 64)
    assert sd.terms_of(text) == whole == Counter({"ab": 5_000, "cdé": 5_000, "x" * 900: 1, "end": 1})


def test_merge_emits_whole_terms_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sd, "CHUNK_POSTINGS", 2)
    rng = np.random.default_rng(4)
    wanted, rows = Counter(), []
    for run_number in range(6):
        terms = sorted(set(rng.integers(0, 40, 20).tolist()))
        names = [f"t{t:02}" for t in terms]
        wanted.update({(t, "s"): t0 for t, t0 in zip(names, terms)})
        table = pa.table({"term": names, "source": ["s"] * len(names), "count": pa.array(terms, pa.int64()), "docs": pa.array([1] * len(names), pa.int64())})
        batch = sd._chunks(0, 0, run_number, "en", table)
        rows += [(("k",), batch.column("first")[i].as_py(), batch.column("chunk")[i].as_py()) for i in range(batch.num_rows)]
    rows.sort(key=lambda r: r[1])
    out = [(t, s, c) for _, found in sd._merge_keyed(iter(rows), 5) for t, s, c in zip(*(found.column(c).to_pylist() for c in ("term", "source", "count")))]
    assert [t for t, _, _ in out] == sorted({t for t, _ in wanted})
    assert {(t, s): c for t, s, c in out} == wanted
