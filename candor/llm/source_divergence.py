"""Source divergence audit by single-pass in-memory indexing (operator 12).

Every task counts the terms of its documents in an in-memory index (language,
source, term). When a block of postings is full, it is spilled as a term-sorted run,
cut by hash shards of the terms. Per shard the runs are merged by a heap of
open chunks into frequencies. Divergences of the sources of a language follow from
the frequencies: what two sources would differ by if no term occurred is known in closed form,
and the postings stream by once for the corrections.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.operators.skew import lookup
from candor.session import written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # fixed value: ASCII letters and everything beyond ASCII
LEAST_DOCUMENTS = 30  # documents of a language that a kept term occurs in
SCALE, SMOOTHING = 1_000_000_000, 5  # fixed values of the shares
TOP_TERMS = 50  # fixed value: reported terms per source
BLOCK_POSTINGS = 400_000  # postings that a task holds before it spills a run
CHUNK_POSTINGS = 4_096  # postings of one chunk of a run
MERGE_POSTINGS = 400_000  # postings of open chunks that are merged at once
FAN_IN = 256  # runs merged at once; more are merged in several levels
WINDOW = 1 << 22  # characters of a long text that are cut into terms at once
BLOCK_SOURCES = 128  # sources of one side of a tile of pairs
TILE_TERMS = 8_192  # terms of one tile, about

_TERM = re.compile(TERM)
_GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(65, 91)}
_CHUNK = "shard int, lane int, run long, lang string, first string, chunk binary"
_FREQUENCY = "lang string, term string, source string, count long, total long, docs long, head boolean"


def terms_of(text: str) -> Counter:
    """Counts of the terms of a whole text; long texts in windows that end between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = at + WINDOW
        if stop < len(text):
            gap = _GAP.search(text, stop)
            stop = gap.start() if gap else len(text)
        found.update(_TERM.findall(text[at:stop].translate(_LOWER)))
        at = stop
    return found


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(chunk: bytes) -> pa.Table:
    with pa.ipc.open_stream(chunk) as stream:
        return stream.read_all()


def _chunks(shard: int, lane: int, run: int, lang: str, table: pa.Table) -> pa.RecordBatch:
    """Rows of one language and shard of a run, sorted by (term, source), as chunk rows."""
    parts = [table.slice(i, CHUNK_POSTINGS) for i in range(0, table.num_rows, CHUNK_POSTINGS)]
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * n, pa.int32()),
            pa.array([lane] * n, pa.int32()),
            pa.array([run] * n, pa.int64()),
            pa.array([lang] * n, pa.string()),
            pa.array([p.column("term")[0].as_py() for p in parts], pa.string()),
            pa.array([_pack(p) for p in parts], pa.binary()),
        ],
        names=["shard", "lane", "run", "lang", "first", "chunk"],
    )


def _run(index: dict, shards: int, run: int):
    """One spilled run: postings in term order, cut by language and hash shard."""
    by_lang: dict[str, list] = {}
    for (lang, source), postings in index.items():
        by_lang.setdefault(lang, []).append((source, postings))
    for lang, groups in by_lang.items():
        terms = [t for _, postings in groups for t in postings]
        packed = np.concatenate([np.fromiter(p.values(), np.int64, len(p)) for _, p in groups])
        number = np.repeat(np.arange(len(groups)), [len(p) for _, p in groups])
        home = np.fromiter((zlib.crc32(t.encode()) for t in terms), np.int64, len(terms)) % shards
        whole = pa.table({
            "term": pa.array(terms, pa.string()),
            "source": pa.array([s for s, _ in groups], pa.string()).take(pa.array(number)),
            "count": packed >> 32,
            "docs": packed & 0xFFFFFFFF,
        })
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(shards + 1))
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            part = whole.take(pa.array(order[bounds[shard] : bounds[shard + 1]]))
            yield _chunks(shard, 0, run, lang, part.sort_by([("term", "ascending"), ("source", "ascending")]))


def runs(docs: DataFrame, shards: int, text: str, lang: str, source: str, block: int) -> DataFrame:
    """Chunk rows of all runs. The empty term stands for the group itself; its docs are the group's documents."""

    def task(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        index: dict[tuple[str, str], dict[str, int]] = {}
        held = 0
        for batch in batches:
            for t, g, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                postings = index.setdefault((g, s), {})
                before = len(postings)
                postings[""] = postings.get("", 0) + 1
                for term, n in terms_of(t).items():
                    # occurrences above bit 32, documents below
                    postings[term] = postings.get(term, 0) + (n << 32) + 1
                held += len(postings) - before
                if held >= block:
                    yield from _run(index, shards, number)
                    index, held, number = {}, 0, number + 1
        if index:
            yield from _run(index, shards, number)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    return docs.select(*columns).mapInArrow(task, _CHUNK)


def _summed(table: pa.Table) -> pa.Table:
    """One row per (term, source), in that order."""
    found = table.group_by(["term", "source"]).aggregate([("count", "sum"), ("docs", "sum")])
    found = found.rename_columns(["term", "source", "count", "docs"])
    return found.sort_by([("term", "ascending"), ("source", "ascending")])


def _merge_keyed(rows, limit: int):
    """(key, summed table of a range of whole terms): a heap merge of the sorted chunks of every key.

    ``rows`` yields (key, first term, chunk) ordered by key and first term. The heap holds the open chunks by
    their last term. Every term below the first term of the chunk to come is complete.
    """
    key, heap, held, serial, floor = None, [], 0, 0, 0

    def close(bound):
        nonlocal heap, held, floor
        done, rest = [], []
        while heap and (bound is None or heap[0][0] < bound):
            done.append(heapq.heappop(heap)[2])
        for last, n, table in heap if bound is not None else []:
            cut = pc.sum(pc.less(table.column("term"), bound)).as_py() or 0
            if cut:
                done.append(table.slice(0, cut))
            rest.append((last, n, table.slice(cut)))
        heap = rest
        heapq.heapify(heap)
        held = floor = sum(t.num_rows for _, _, t in heap)
        return _summed(pa.concat_tables(done)) if done else None

    for at, first, chunk in rows:
        if at != key:
            out = close(None)
            if out is not None:
                yield key, out
            key = at
        elif held >= max(limit, 2 * floor):
            out = close(first)
            if out is not None:
                yield key, out
        table = _unpack(chunk)
        heapq.heappush(heap, (table.column("term")[-1].as_py(), serial, table))
        serial += 1
        held += table.num_rows
    out = close(None)
    if out is not None:
        yield key, out


def _chunk_rows(batches):
    for batch in batches:
        shard, lane, lang, first, chunk = (batch.column(batch.schema.get_field_index(c)) for c in ("shard", "lane", "lang", "first", "chunk"))
        for i in range(batch.num_rows):
            yield (shard[i].as_py(), lane[i].as_py(), lang[i].as_py()), first[i].as_py(), chunk[i].as_py()


def _in_order(table: DataFrame, parts: int) -> DataFrame:
    return table.repartition(parts, "shard", "lane").sortWithinPartitions("shard", "lane", "lang", "first")


def merged_runs(table: DataFrame, lanes: int, parts: int, limit: int) -> DataFrame:
    """One level of merging: about ``FAN_IN`` runs of a shard become one."""

    def task(batches):
        for (shard, lane, lang), found in _merge_keyed(_chunk_rows(batches), limit):
            yield _chunks(shard, 0, lane, lang, found)

    lane = F.pmod(F.xxhash64("run"), F.lit(lanes)).cast("int")
    return _in_order(table.withColumn("lane", lane), parts).mapInArrow(task, _CHUNK)


def frequencies(table: DataFrame, least_documents: int, parts: int, limit: int) -> DataFrame:
    """(lang, term, source, count, total, docs, head) of kept terms, and of the groups themselves (term '').

    total and docs: occurrences and documents of the term in the language; head marks one row per term.
    """

    def task(batches):
        for (_, _, lang), found in _merge_keyed(_chunk_rows(batches), limit):
            term = found.column("term").combine_chunks()
            fresh = np.ones(len(term), bool)
            fresh[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(fresh)
            count = found.column("count").to_numpy()
            docs = np.add.reduceat(found.column("docs").to_numpy(), begin)
            total = np.add.reduceat(count, begin)
            at = np.cumsum(fresh) - 1
            marker = pc.equal(term, "").to_numpy(zero_copy_only=False)
            kept = np.flatnonzero((docs[at] >= least_documents) | marker)
            if not len(kept):
                continue
            pick = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(kept), pa.string()),
                    term.take(pick),
                    found.column("source").combine_chunks().take(pick),
                    pa.array(count[kept]),
                    pa.array(total[at][kept]),
                    pa.array(docs[at][kept]),
                    pa.array(fresh[kept]),
                ],
                names=["lang", "term", "source", "count", "total", "docs", "head"],
            )

    return _in_order(table, parts).mapInArrow(task, _FREQUENCY)


def _share(count: str, n: str, v: str):
    """1 + floor(SCALE * (count + SMOOTHING) / (n + SMOOTHING * v)), exact at any size; null without terms."""
    wide = f"(CAST({n} AS DECIMAL(20,0)) + {SMOOTHING} * CAST({v} AS DECIMAL(18,0)))"
    return F.expr(
        f"CASE WHEN {v} > 0 THEN 1 + (CAST({count} + {SMOOTHING} AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0))) div {wide} END"
    ).cast("long")


def _pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) of all ordered pairs of sources of a language.

    ``entries``: lang, term, source, p. ``groups``: lang, source, sources, v, weight, p0 (the share of a term that does
    not occur). A pair starts from v * |p0 - p0'|; tiles of about BLOCK_SOURCES sources on a side and TILE_TERMS
    terms stream the postings and correct it. Pairs leave a tile as sums, so their number does not grow with the terms.
    """
    side = F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int")
    slabs = F.greatest(F.lit(1), F.ceil(F.col("v") / TILE_TERMS)).cast("int")
    placed = groups.where("sources > 1").select(
        "lang", "source", "v", "weight", F.coalesce("p0", F.lit(0).cast("long")).alias("p0"),
        side.alias("side"), slabs.alias("slabs"), F.pmod(F.xxhash64("source"), side).cast("int").alias("block"),
    )
    carried = ("lang", "source", "term", "p", "v", "side", "block", "slab")
    marks = placed.select("*", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"))
    named = lookup(entries, placed.drop("p0"), ["lang", "source"], "weight").withColumn("slab", F.pmod(F.xxhash64("term"), F.col("slabs")).cast("int"))
    rows = (
        marks.select(*carried)
        .unionByName(named.select(*carried))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
        .select("lang", "slab", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "source", "term", "p", "v")
    )

    def tile(table: pa.Table) -> pa.Table:
        lo, hi, slab, v = (table.column(c)[0].as_py() for c in ("lo", "hi", "slab", "v"))
        term = table.column("term").combine_chunks().dictionary_encode()
        source = table.column("source").combine_chunks().dictionary_encode()
        names = source.dictionary.to_pylist()
        s = source.indices.to_numpy()
        p = table.column("p").to_numpy()
        mark = term.indices.is_null().to_numpy(zero_copy_only=False)
        block = np.zeros(len(names), np.int64)
        block[s] = table.column("block").to_numpy()
        base = np.zeros(len(names), np.int64)
        base[s[mark]] = p[mark]
        shares = np.repeat(base[:, None], len(term.dictionary), 1)
        shares[s[~mark], term.indices.filter(pa.array(~mark)).to_numpy()] = p[~mark]
        right = np.flatnonzero(block == hi)
        known = (v if slab == 0 else 0) - shares.shape[1]  # terms that count with the shares of absent ones
        one, two, value = [], [], []
        for i in np.flatnonzero(block == lo).tolist():
            sums = np.abs(shares[right] - shares[i]).sum(1) + known * np.abs(base[right] - base[i])
            for j, c in zip(right.tolist(), sums.tolist()):
                if i != j:
                    one.append(names[i])
                    two.append(names[j])
                    value.append(c)
        if lo != hi:
            one, two, value = one + two, two + one, value * 2
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(one, pa.string()),
                         "other": pa.array(two, pa.string()), "value": pa.array(value, pa.int64())})

    found = rows.groupBy("lang", "slab", "lo", "hi").applyInArrow(tile, "lang string, source string, other string, value long")
    return found.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS, block: int = BLOCK_POSTINGS, shards: int | None = None, fan_in: int = FAN_IN, merge: int = MERGE_POSTINGS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ.

    Null text, language and source are read as ''. Only A-Z are lower-cased. Part ``pair`` has every other source of the language,
    part ``term`` the ``top`` kept terms by which a source exceeds its language. Ranks go by value descending, ties by
    item ascending in UTF-8. Every occurring (language, source) takes part, even without terms; a language without kept terms has pairs of value 0.
    Repeated rows count as documents of their own; an empty table gives no rows; other columns are not read.
    ``block`` bounds a task's index, ``merge`` the open chunks, ``fan_in`` the runs of one merge, ``shards`` the cuts of a run; no result depends on them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(runs(docs, shards or 2 * parts, text, lang, source, block), "runs")
    left = table.select("run").distinct().count()
    while left > fan_in:
        left = -(-left // fan_in)
        table = written(merged_runs(table, left, parts, merge), "merged-runs")
    found = written(frequencies(table, least_documents, parts, merge), "frequencies")
    kept = found.where("term <> ''")
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("weight"))
    of_lang = kept.groupBy("lang").agg(F.sum("count").alias("m"), F.count_if("head").alias("v"))
    sources = found.where("term = ''").select("lang", "source")
    per_lang = sources.groupBy("lang").agg(F.count("*").alias("sources"))
    zero = F.lit(0).cast("long")
    groups = written(
        sources.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(per_lang, "lang").select(
            "lang", "source", "sources", *[F.coalesce(c, zero).alias(c) for c in ("n", "m", "v", "weight")]
        ).withColumn("p0", _share("0L", "n", "v")),
        "groups",
    )
    of_source = groups.select("lang", "source", "n", "m", "v", "weight")
    entries = lookup(kept, of_source, ["lang", "source"], "weight").select(
        "lang", "term", "source", _share("count", "n", "v").alias("p"), _share("total", "m", "v").alias("q"))
    entries = written(entries, "entries")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = _pair_values(entries.drop("q"), groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
