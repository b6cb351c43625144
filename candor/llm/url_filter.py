"""URL rules by Bloom filter cascades (operator 1).

The keys of a URL are the suffixes of its host at label borders, each with a
prefix of its path. One cascade holds the keys that allow, one those that block:
level 0 encodes the listed keys, level 1 the keys of the corpus that level 0 takes
for listed ones though they are not, level 2 the listed keys that level 1 takes
for those, and so on until no error is left. Over the corpus's own keys, all of
which are tested when the levels are built, membership is then exact, and judging
a URL needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import Shared, without
from candor.session import written

BITS_PER_KEY = 12
HASHES = 6
SHARD_KEYS = 8_000_000  # listed keys of one cascade (12 MB); longer lists are judged in several passes
MOST_LEVELS = 64
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: str) -> Column:
    """What follows the first ``://``; empty where there is none."""
    column = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(column, "://")
    return F.when(at > 0, F.substr(column, at + 3)).otherwise("")


def keys_of(host: str, path: str, lengths: list[int]) -> Column:
    """Keys of a URL, longest first: host suffixes with path prefixes of the rules' lengths."""
    labels = F.split(F.col(host), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substr(F.col(path), F.lit(1), n))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(both, lambda a, b: F.length(b) - F.length(a))
    )


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def places(one: np.ndarray, two: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit places (keys x HASHES) of keys with these two hashes at one level."""
    a, b = one.view(np.uint64), two.view(np.uint64)
    a = (a ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    b = (b + a) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    a, b = a ^ (a >> np.uint64(29)), b ^ (b >> np.uint64(31))
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


@dataclass(frozen=True)
class Cascade:
    """Bit arrays of the levels."""

    levels: tuple[np.ndarray, ...] = ()

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether keys with these hashes are listed."""
        answer = np.full(len(one), len(self.levels) % 2 == 1)  # of keys that every level holds
        open_ = np.ones(len(one), bool)
        for i, bits in enumerate(self.levels):
            missing = open_ & ~_held(bits, one, two, i)
            answer[missing] = i % 2 == 1
            open_ &= ~missing
        return answer


def _held(bits: np.ndarray, one: np.ndarray, two: np.ndarray, level: int) -> np.ndarray:
    at = places(one, two, level, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _filter(keys: DataFrame, level: int) -> np.ndarray:
    """Bloom filter of the rows (one, two), made in parts and joined by a bitwise or."""
    total = keys.count()
    size = max(64, -(-total * BITS_PER_KEY // 64) * 8)  # bytes

    def task(batches):
        for batch in batches:
            at = places(np.asarray(batch.column(0)), np.asarray(batch.column(1)), level, size * 8).ravel()
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"]
            )

    words = keys.select("one", "two").mapInArrow(task, "word long, bits long")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    made = np.zeros(size // 8, np.int64)
    made[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return made.view(np.uint8)


def _holding(keys: DataFrame, bits: np.ndarray, level: int) -> DataFrame:
    """Rows (key, one, two) that the filter of a level holds."""
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    def task(batches):
        for batch in batches:
            held = _held(shared.value, np.asarray(batch.column(1)), np.asarray(batch.column(2)), level)
            yield batch.filter(pa.array(held))

    return keys.select("key", "one", "two").mapInArrow(task, "key string, one long, two long")


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the listed keys over the keys of the corpus, both (key, one, two) and distinct."""
    if listed.isEmpty():
        return Cascade()
    levels = [_filter(listed, 0)]
    wrong = _holding(universe, levels[0], 0).distinct().join(listed.select("key"), "key", "left_anti")
    mine, other = listed, written(wrong, "cascade-errors")
    while not other.isEmpty():  # ``other`` passes the last level and should not
        if len(levels) >= MOST_LEVELS:
            raise RuntimeError("two different keys have equal hashes")
        levels.append(_filter(other, len(levels)))
        mine, other = other, written(_holding(mine, levels[-1], len(levels) - 1), "cascade-errors")
    return Cascade(tuple(levels))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Add host, path, rule and verdict of every URL.

    ``rules`` has the columns host, path and verdict (allow or block). A rule fits
    its host and all subdomains where the path starts with the rule's; the longest
    wins, and block before allow where both list it. A URL that no rule fits is
    allowed, with a null rule; so is one that is null or has no ``://``, whose host
    and path are empty. Rules with nulls are ignored. Repeated rows stay; columns
    named like the new ones are replaced.
    """
    clean = rules.where("host is not null and path is not null").where(F.col("verdict").isin(ALLOW, BLOCK))
    named = clean.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), "verdict").distinct()
    lengths = sorted(r[0] for r in clean.select(F.length("path")).distinct().collect())
    names = ["host", "path", "rule", "verdict"]
    rows = without(df, [n for n in names if n != url]).withColumn("_host", host_of(url)).withColumn("_path", path_of(url))
    rows = without(rows, names) if url in names else rows
    rows = rows.withColumn("_keys", keys_of("_host", "_path", lengths))
    total = named.count()
    shards = max(1, -(-total // shard_keys))
    rows = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(ALLOW))
    for shard in range(shards):
        part = lambda key: F.pmod(F.xxhash64(key, F.lit(2)), F.lit(shards)) == shard
        own = named.where(part(F.col("key")))
        keys = F.filter("_keys", part) if shards > 1 else F.col("_keys")
        universe = rows.select(keys.alias("keys")).select(F.explode("keys").alias("key"))
        one, two = _hashes(F.col("key"))
        universe = universe.select("key", one.alias("one"), two.alias("two"))
        cascades = []
        for verdict in (BLOCK, ALLOW):
            listed = own.where(F.col("verdict") == verdict).select("key", one.alias("one"), two.alias("two"))
            cascades.append(build(listed, universe))
        rows = _judged(rows, keys, cascades)
        if shards > 1:
            rows = written(rows, "judged")
    return rows.drop("_keys").withColumnsRenamed({"_host": "host", "_path": "path"})


def _judged(rows: DataFrame, keys: Column, cascades: list[Cascade]) -> DataFrame:
    """Where the longest listed key of these is longer than the rule so far, it becomes the rule."""
    shared = Shared(rows.sparkSession, cascades)
    work = rows.withColumn("_these", keys)
    work = work.withColumn("_one", F.transform("_these", lambda k: _hashes(k)[0]))
    work = work.withColumn("_two", F.transform("_these", lambda k: _hashes(k)[1]))
    names = [c for c in rows.columns if c not in ("rule", "verdict")]
    work = work.select(*[F.col(f"`{c}`") for c in names], "rule", "verdict", "_one", "_two", F.col("_these"))

    def task(batches):
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("_one", "_two", "_these", "rule", "verdict")}
            one, two = (np.asarray(column[n].flatten(), np.int64) for n in ("_one", "_two"))
            sizes = np.asarray(column["_these"].value_lengths(), np.int64)
            block, allow = (c.listed(one, two) for c in shared.value)
            row = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(block | allow)
            first = hit[np.unique(row[hit], return_index=True)[1]]  # keys stand longest first
            rule, verdict = column["rule"].to_pylist(), column["verdict"].to_pylist()
            texts = column["_these"].flatten().take(pa.array(first)).to_pylist()
            for i, at, text in zip(row[first].tolist(), first.tolist(), texts):
                if rule[i] is None or len(text) > len(rule[i]):
                    rule[i], verdict[i] = text, BLOCK if block[at] else ALLOW
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, "rule", "verdict"]
            )

    kinds = work.select(*[F.col(f"`{c}`") for c in names], "rule", "verdict").schema
    return work.mapInArrow(task, kinds)
