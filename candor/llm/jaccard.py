"""Exact n-gram Jaccard join by a token-group matrix (operator 10).

Two documents link when their shingle sets have a Jaccard similarity of at least
the threshold. With all shingles in one global order, rarer ones first, linked
documents share some of the first few shingles of each (a prefix). So

1. every document sends its prefix to be counted; shingles that only one set has
   drop out, and so do documents with too few shared ones;
2. the others are partitioned into groups of similar size around their commonest
   shared shingle, and a matrix of shingle and group holds each group's union;
3. a set opens another group only if its overlap with the group's union allows a
   link, and sets that open each other's groups meet in blocks of bounded size,
   where whole sets are compared.

Members of a large group that link to its leader are one component already and
need not meet each other. Blocks give a spanning forest of their links, never all
pairs. Bounds and order decide only what is compared; every link is found.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import map_texts, slices
from candor.operators.graph import connected_components
from candor.operators.skew import balanced_join, lookup, small_enough
from candor.session import written

WORDS = 5
PERCENT = 75
SEPARATORS = (0x20, *range(0x09, 0x0E))
LOCAL_REPEATS = 3  # sets of one slice that hold a shingle before it is reported as common
COMMON = 100_000  # common shingles that are broadcast to order by (1.6 MB); the order only steers the cost
BUCKET = 100_000  # prefix entries that one task counts at a time
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
FILTER_BITS = 1 << 26  # of the filter of candidate sets, at most (8 MB)
WIDE = 16  # a shingle of as many sets of a block is counted by a matrix product

_rng = np.random.default_rng(11)
SALT = _rng.integers(0, 2**64, (64, 256), np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.isin(np.arange(256), SEPARATORS)
SALT[:, BREAK] = 0


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of every whole text.

    A shingle is ``words`` neighbouring words, A-Z lower-cased; a text of fewer
    words has its whole sequence as one, a text without words has none.
    """
    raw = [(t or "").encode() + b" " for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    gap = BREAK[data]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(raw)
    length = np.diff(np.r_[start, len(data)])
    body = data[start[0] :]
    place = np.arange(len(body), dtype=np.int32) - np.repeat((start - start[0]).astype(np.int32), length)
    term = SALT[place & 63, body]
    if length.max() > 64:
        term *= (2 * (place >> 6) + 1).astype(np.uint64)
    word = mix(np.add.reduceat(term, start - start[0]))
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    number = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(number) - number
    code = np.full(len(word), words, np.uint64)
    short = number < words
    code[np.repeat(short, number)] = number[doc[np.repeat(short, number)]]
    # word k of the shingle that starts at each word; a short text's sequence starts at its first word only
    code = mix(code)
    for k in range(words):
        ahead = np.zeros_like(word)
        ahead[: len(word) - k] = word[k:]
        there = np.arange(len(word)) + k < np.repeat(first + number, number)
        code = np.where(there, mix(code * np.uint64(0x9E3779B97F4A7C15) + ahead), code)
    left = np.repeat(first + number, number) - np.arange(len(word))
    valid = np.where(np.repeat(short, number), np.arange(len(word)) == np.repeat(first, number), left >= words)
    found = []
    for i, n in enumerate(number.tolist()):
        own = code[first[i] : first[i] + n][valid[first[i] : first[i] + n]]
        own.sort()
        found.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
    return found


def digest(shingles: np.ndarray) -> str | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def short_key(kind: str) -> int:
    """The part of a set's digest that stands for it in prefixes."""
    return int(kind[:16], 16) - (1 << 63)


def required(n: int) -> int:
    """Prefix shingles that linked sets share, by the size of the smaller one."""
    return 1 + n // 50


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + required(n))


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set: those that are not common by value, then the common ones by count."""
    most = prefix_length(len(shingles), percent)
    if not len(common):
        return shingles[:most]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    often = common[at] == shingles
    first = shingles[~often][:most]
    if len(first) < most:
        rest, weight = shingles[often], counts[at[often]]
        first = np.r_[first, rest[np.lexsort((rest, weight))][: most - len(first)]]
    return first


def sketch(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Every row's id with its set's size and digest (``kind``); a slice's first row reports its common shingles."""

    def make():
        def work(texts):
            sets = shingle_sets(texts, words)
            kinds = [digest(s) for s in sets]
            distinct = {k: s for k, s in zip(kinds, sets) if k}
            report = [None] * len(texts)
            if distinct:
                values, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                often = counts >= LOCAL_REPEATS
                if often.any():
                    report[0] = values[often].tobytes() + counts[often].astype(np.uint64).tobytes()
            return [[len(s) for s in sets], kinds, [k and short_key(k) for k in kinds], report]

        return work

    fields = [
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("_kind", T.StringType()),
        T.StructField("_key", T.LongType()),
        T.StructField("_common", T.BinaryType()),
    ]
    return map_texts(docs, text, make, fields, keep=[doc_id])


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most often reported, sorted by value, with their counts."""

    def opened(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                both = np.frombuffer(raw, np.uint64)
                half = len(both) // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:half].view(np.int64)), pa.array(both[half:].astype(np.int64))], names=["shingle", "n"]
                )

    found = (
        rows.where("_common is not null")
        .select("_common")
        .mapInArrow(opened, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "shingle")
        .limit(COMMON)
        .toPandas()
    )
    values = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["n"].to_numpy(np.int64)[order]


def shared_prefixes(docs: DataFrame, text: str, common, buckets: int, words: int, percent: int) -> DataFrame:
    """(shingle, key) of prefix shingles that more than one set has; the shingle is a 60-bit stand-in."""
    common = docs.sparkSession.sparkContext.broadcast(common)
    rows = docs.select(F.col(text).cast("string").alias("_text")).where("_text is not null")

    def deal(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = {digest(s): s for s in shingle_sets(part.column(0).to_pylist(), words) if len(s)}
                firsts = [prefix(s, *common.value, percent) for s in sets.values()]
                if not firsts:
                    continue
                keys = np.repeat(np.array([short_key(k) for k in sets], np.int64), [len(f) for f in firsts])
                code = mix(np.concatenate(firsts))
                bucket = (code % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, tail, keys = bucket[order], (code[order] >> np.uint64(32)).astype(np.uint32), keys[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                data = [t.tobytes() + k.tobytes() for t, k in zip(np.split(tail, edge[1:]), np.split(keys, edge[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edge]), pa.array(data, pa.binary())], names=["bucket", "data"]
                )

    def count(key, table):
        tails, keys = [], []
        for raw in table.column("data").to_pylist():
            n = len(raw) // 12
            tails.append(np.frombuffer(raw, np.uint32, n))
            keys.append(np.frombuffer(raw, np.int64, n, 4 * n))
        tail, who = np.concatenate(tails), np.concatenate(keys)
        order = np.lexsort((who, tail))
        tail, who = tail[order], who[order]
        fresh = np.r_[True, (tail[1:] != tail[:-1]) | (who[1:] != who[:-1])]
        tail, who = tail[fresh], who[fresh]
        begins = np.r_[True, tail[1:] != tail[:-1]]
        size = np.bincount(np.cumsum(begins) - 1)
        several = np.repeat(size, size) > 1
        code = (np.int64(key[0].as_py()) << 32) | tail[several].astype(np.int64)
        return pa.table({"shingle": code, "key": who[several], "df": np.repeat(size, size)[several]})

    dealt = rows.mapInArrow(deal, "bucket long, data binary")
    return dealt.groupBy("bucket").applyInArrow(count, "shingle long, key long, df long")


def need(n) -> F.Column:
    return 1 + F.floor(n / 50)


def candidate_texts(docs: DataFrame, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """(kind, text), one row for each wanted set; a filter of their keys keeps most other texts from moving."""
    total = wanted.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << math.ceil(math.log2(16 * total + 1))))
    place = F.pmod(F.col("key"), F.lit(bits))
    cells = (
        wanted.select(F.shiftright(place, 5).alias("cell"), (place % 32).cast("int").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))
        .toPandas()
    )
    filled = np.zeros(bits // 32, np.int64)
    filled[cells["cell"].to_numpy(np.int64)] = cells["set"].to_numpy(np.int64)
    filled = docs.sparkSession.sparkContext.broadcast(filled.astype(np.uint32))
    rows = docs.select(F.col(text).cast("string").alias("_text")).where("_text is not null")

    def pick(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column(0).to_pylist()
                found = {}
                for t, s in zip(texts, shingle_sets(texts, words)):
                    if len(s):
                        kind = digest(s)
                        spot = short_key(kind) % bits
                        if filled.value[spot >> 5] >> np.uint32(spot & 31) & 1:
                            found[kind] = t
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], names=["kind", "text"]
                )

    picked = rows.mapInArrow(pick, "kind string, text string")
    return picked.join(wanted, "kind").groupBy("kind").agg(F.min("text").alias("text"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of the sets of one block."""
    m = len(sets)
    _, code, size = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    result = np.zeros((m, m), np.float32)
    wide = np.flatnonzero(size >= WIDE)
    for i in range(0, len(wide), 4096):
        spot = np.full(len(size), -1)
        spot[wide[i : i + 4096]] = np.arange(len(wide[i : i + 4096]))
        held = spot[code] >= 0
        matrix = np.zeros((m, len(wide[i : i + 4096])), np.float32)
        matrix[who[held], spot[code[held]]] = 1
        result += matrix @ matrix.T
    few = (size[code] > 1) & (size[code] < WIDE)
    order = np.argsort(code[few], kind="stable")
    code, who = code[few][order], who[few][order]
    flat = np.zeros(m * m, np.int64)
    for step in range(1, WIDE):  # places of the same shingle that lie ``step`` apart
        if len(code) <= step:
            break
        same = code[step:] == code[:-step]
        if not same.any():
            break
        flat += np.bincount(who[:-step][same] * m + who[step:][same], minlength=m * m)
    return result + (flat.reshape(m, m) + flat.reshape(m, m).T)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.array([[n[0], 0], [0, n[1]]], float)
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        common = overlaps(sets)
    common = np.rint(common).astype(np.int64)
    found = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(found, False)
    return found


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean matrix of links."""
    edges, free = [], np.ones(len(links), bool)
    for root in np.flatnonzero(links.any(1)).tolist():
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(links[at] & free)
            free[near] = False
            edges.extend((at, x) for x in near.tolist())
            queue.extend(near.tolist())
    return edges


def compare(units: DataFrame, words: int, percent: int) -> DataFrame:
    """(src, dst): a spanning forest of the links within every unit (bounded rows of kind and text)."""
    dealt = units.repartition("unit").sortWithinPartitions("unit", "kind")

    def work(held):
        kinds, texts = zip(*held.items())
        sets = shingle_sets(list(texts), words)
        return [(kinds[a], kinds[b]) for a, b in forest(linked(sets, percent))]

    def task(batches):
        now, held = None, {}
        for batch in batches:
            edges = []
            for unit, kind, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "kind", "text"))):
                if unit != now:
                    edges += work(held) if len(held) > 1 else []
                    now, held = unit, {}
                held[kind] = text
            if edges:
                yield _edges(edges)
        if len(held) > 1:
            yield _edges(work(held))

    return dealt.select("unit", "kind", "text").mapInArrow(task, "src string, dst string")


def _edges(pairs):
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["src", "dst"])


def to_leader(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(kind, leader) of the rows (kind, text, leader, leader_text) that link."""

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                kind, text, leader, other = (part.column(c).to_pylist() for c in ("kind", "text", "leader", "leader_text"))
                heads = dict(zip(leader, other))
                head = dict(zip(heads, shingle_sets(list(heads.values()), words)))
                keep = [
                    (k, x)
                    for k, s, x in zip(kind, shingle_sets(text, words), leader)
                    if linked([s, head[x]], percent)[0, 1]
                ]
                yield _edges(keep).rename_columns(["kind", "leader"])

    return rows.select("kind", "text", "leader", "leader_text").mapInArrow(task, "kind string, leader string")


def opened(member: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """(kind, g, other, bytes): sets and the other groups that may hold a set they link to.

    A group's union of prefix shingles has to share as many with the set as a link
    asks for, the sizes have to fit, and some set of that group has to open this one.
    """
    shape = member.groupBy(F.col("g").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    held = written(
        prefixes.join(member.select("kind", "key", "n", "g", "bytes"), "key").select("shingle", "kind", "n", "g", "bytes"), "jaccard-held"
    )
    union = held.select("shingle", F.col("g").alias("other")).distinct()
    met = balanced_join(held, union, ["shingle"]).where("g <> other")
    met = met.groupBy("kind", "g", "other", "n", "bytes").agg(F.count("*").alias("overlap"))
    met = written(met.where(F.col("overlap") >= need(F.ceil(F.col("n") * percent / 100))), "jaccard-met")
    # pairs of groups are few next to their sets: what holds for a pair is worked out there and looked up
    pairs = written(met.groupBy("g", "other").agg(F.count("*").alias("rows")).join(shape, "other"), "jaccard-pairs")
    fits = (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    met = written(lookup(met, pairs, ["g", "other"], "rows").where(fits).select("kind", "g", "other", "bytes"), "jaccard-opened")
    pairs = met.groupBy("g", "other").agg(F.count("*").alias("rows"))
    back = pairs.select(F.col("other").alias("g"), F.col("g").alias("other"))
    return lookup(met, written(pairs.join(back, ["g", "other"]), "jaccard-both"), ["g", "other"], "rows")


def meetings(grouped: DataFrame, across: DataFrame) -> DataFrame:
    """(unit, kind): units of at most two blocks in which all sets that have to be compared meet.

    ``grouped`` has (kind, g, star, bytes); the sets of a group meet each other, but
    for those with ``star`` 1, which are connected. ``across`` as from ``opened``.
    """
    low, high = F.least("g", "other"), F.greatest("g", "other")
    rows = grouped.select(F.xxhash64("g").alias("u"), F.lit(False).alias("across"), F.lit(0).alias("side"), "star", "kind", "bytes").unionByName(
        across.select(
            F.xxhash64(low, high).alias("u"), F.lit(True).alias("across"), (F.col("g") == high).cast("int").alias("side"), F.lit(0).alias("star"), "kind", "bytes"
        )
    )
    sides = rows.groupBy("u", "across", "side", "star").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    meeting = F.sum("rows").over(Window.partitionBy("u")) > 1  # of at most two sides
    sides = written(sides.withColumn("parts", parts).withColumn("meeting", meeting).where("meeting"), "jaccard-sides")
    blocks = sides.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    b = F.struct("side", "star", "part")
    one, two = blocks.select("u", "across", b.alias("one")), blocks.select("u", b.alias("two"))
    both = one.join(two, "u")
    inner = (F.col("one") <= F.col("two")) & ~((F.col("one.star") == 1) & (F.col("two.star") == 1))
    both = both.where(F.when(F.col("across"), F.col("one.side") < F.col("two.side")).otherwise(inner))
    units = both.select(F.xxhash64("u", "one", "two").alias("unit"), "u", F.explode(F.array_distinct(F.array("one", "two"))).alias("b"))
    placed = rows.join(sides.select("u", "side", "star", "parts"), ["u", "side", "star"])
    placed = placed.select("u", F.struct("side", "star", F.pmod(F.xxhash64("kind"), "parts").cast("int").alias("part")).alias("b"), "kind")
    return units.join(placed, ["u", "b"]).select("unit", "kind")


def links(docs: DataFrame, rows: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(src, dst) over set digests, connecting exactly the sets that chains of links connect."""
    total = rows.agg(F.sum(F.expr(f"n_shingles - ceil({percent} * n_shingles / 100) + 1 + floor(n_shingles / 50)"))).first()[0]
    common = common_shingles(rows)
    found = written(
        shared_prefixes(docs, text, common, max(1, math.ceil((total or 0) / BUCKET)), words, percent), "jaccard-prefixes"
    )
    kinds = rows.where("_kind is not null").select(F.col("_kind").alias("kind"), F.col("_key").alias("key"), F.col("n_shingles").alias("n")).distinct()
    # a set's shared prefix shingles, and the group of the commonest one
    best = F.max(F.struct("df", "shingle")).alias("best")
    per_key = found.groupBy("key").agg(F.count("*").alias("shared"), best)
    level = F.floor(F.log("n") / math.log(100 / percent))  # sets that link differ by one level at most
    member = written(
        kinds.join(per_key, "key")
        .where(F.col("shared") >= need(F.ceil(F.col("n") * percent / 100)))
        .select("kind", "key", "n", "shared", F.xxhash64("best.shingle", level).alias("g")),
        "jaccard-members",
    )
    whole = candidate_texts(docs, text, member.select("kind", "key"), words).join(member, "kind")
    whole = written(whole.withColumn("bytes", F.octet_length("text").cast("long")), "jaccard-texts")
    narrow, texts = whole.drop("text"), whole.select("kind", "text")
    # of groups above one block, those that link to the leader are connected and do not meet each other
    size = narrow.groupBy("g").agg(
        F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.struct(F.col("shared") / F.col("n"), "kind")).alias("head")
    )
    size = size.where((F.col("rows") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES)).select("g", F.col("head.kind").alias("leader"))
    members = written(narrow.join(size, "g").select("kind", "leader"), "jaccard-large")
    members = F.broadcast(members) if small_enough(members) else members
    heads = texts.join(members.select(F.col("leader").alias("kind")).distinct(), "kind").select(
        F.col("kind").alias("leader"), F.col("text").alias("leader_text")
    )
    followers = texts.join(members.where("kind <> leader"), "kind").join(heads, "leader")
    stars = written(to_leader(followers, words, percent), "jaccard-stars")
    grouped = narrow.join(stars.select("kind", F.lit(1).alias("star")), "kind", "left").select(
        "kind", "g", F.coalesce("star", F.lit(0)).alias("star"), "bytes"
    )
    meeting = meetings(grouped, opened(narrow, found, percent))
    edges = compare(meeting.join(texts, "kind"), words, percent)
    return edges.unionByName(stars.select(F.col("leader").alias("src"), F.col("kind").alias("dst")))


def _rooted(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, lead) -> tuple[DataFrame, DataFrame]:
    """(rows, rooted): every row's set, and per distinct set the digest that names its group, with the least ``lead`` of its rows."""
    rows = written(sketch(docs, doc_id, text, words), "jaccard-sketch")
    edges = written(links(docs, rows, text, words, percent), "jaccard-links")
    component = connected_components(edges).select(F.col("id").alias("_kind"), F.col("component").alias("_root"))
    kinds = rows.where("_kind is not null").groupBy("_kind").agg(F.min(lead).alias("_low"), F.count("*").alias("_rows"))
    rooted = written(
        kinds.join(component, "_kind", "left").withColumn("_root", F.coalesce("_root", "_kind")), "jaccard-roots"
    )
    return rows, rooted


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest id that chains of links reach, the row's own
    included. Rows with equal sets link. Null and empty texts and texts without
    words have no shingles and keep their own id. Null ids stay null, their
    component is named by its other ids. Repeated rows stay, other columns are left out.
    """
    id_ = F.col(f"`{doc_id}`")
    rows, rooted = _rooted(docs, doc_id, text, words, percent, id_)
    lowest = rooted.groupBy("_root").agg(F.min("_low").alias("component_id"), F.count("*").alias("_kinds"))
    named = written(lookup(rooted, lowest, ["_root"], "_kinds").select("_kind", "component_id", "_rows"), "jaccard-named")
    kept = rows.select(id_, "n_shingles", "_kind")
    with_set = lookup(kept.where("_kind is not null"), named, ["_kind"], "_rows")
    return with_set.drop("_kind").unionByName(kept.where("_kind is null").withColumn("component_id", id_).drop("_kind"))


def one_of_each_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` that stand for their groups of near copies: one row of each group, all columns.

    Groups are those of sets, whatever the ids: rows of one id with unlinked texts belong to different groups. The row with the
    smallest id stays (null ids come last; among texts of one id that with the smallest hash; among rows equal in both the first by their
    other columns). Texts without shingles link with nothing, so all their rows stay, repeated ones too.
    """
    id_ = F.col(f"`{doc_id}`")
    body = F.col(f"`{text}`").cast("string")
    key = F.concat(F.hex(F.xxhash64(body)), F.hex(F.xxhash64(F.lit(17), body)))
    keyed = docs.select(F.struct(id_.isNull().alias("no"), id_.alias("id"), key.alias("key")).alias("_row"), body.alias("_body"))
    _, rooted = _rooted(keyed, "_row", "_body", words, percent, F.col("_row"))
    first = rooted.groupBy("_root").agg(F.min("_low").alias("_low"))
    shingled = F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows that are equal in id and text share a name; at most one of each task is shuffled, and the join finds them in place
    who = lambda id, key: F.concat(F.coalesce(F.concat(F.lit("+"), id.cast("string")), F.lit("-")), F.lit("|"), key)
    comparable = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double", "boolean") and f.name not in (text, doc_id)]
    order = Window.partitionBy("_who").orderBy(*(comparable or [F.lit(1)]))
    single = docs.where(shingled).withColumn("_who", who(id_, key))
    single = single.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    named = first.select(who(F.col("_low.id"), F.col("_low.key")).alias("_who"))
    return single.join(named, "_who", "left_semi").drop("_who").unionByName(docs.where(~shingled))
