"""WARC archives as a chunked record table (operator 4).

A payload is streamed as rows of record and chunk number with a running digest,
so no step after the first builds a whole record. Chunks are written as WARC/1.1
records: the first as ``response``, the others as its ``continuation`` segments,
and payloads that repeat as ``revisit``. Every row of the written text files is
one record, ended by the two line breaks the format asks for, so archives are
ordinary output of Spark's text writer. The header that starts every record holds
a random id of the archive; with the line breaks before it, it is the separator
by which Spark reads records back, also from the middle of a large file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators.skew import lookup
from candor.session import scratch_path, written

CHUNK_BYTES = 256 << 10
BATCH_BYTES = 4 << 20
BREAK = b"\r\n"
# fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """A folder of archive files and the id that starts each of its records."""

    path: str
    token: str

    @property
    def opening(self) -> str:
        return f"{VERSION}\r\nWARC-Warcinfo-ID: <urn:uuid:{self.token}>\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks_of(payload: str | None, size: int = CHUNK_BYTES):
    """(offset, bytes, running SHA-1 as bytes, last) of the UTF-8 payload, cut between characters."""
    data = memoryview((payload or "").encode())
    running, at = hashlib.sha1(), 0
    while True:
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        running.update(data[at:end])
        yield at, data[at:end], running.digest(), end == len(data)
        if end == len(data):
            return
        at = end


def chunk_table(df: DataFrame, key: str, payload: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """(key, chunk, start, length, running_digest, running_sha1, last, data): the payload of every row as a stream of chunks.

    A null payload is empty; an empty payload is one empty chunk. ``with_data``
    False leaves the bytes out.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(payload).cast("string").alias("payload"))
    names = ["key", "chunk", "start", "length", "running_digest", "running_sha1", "last"] + ["data"] * with_data
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.binary()] * with_data

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def task(batches):
        out, held = [], 0
        for batch in batches:
            for key_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, (start, data, digest, last) in enumerate(chunks_of(text.as_py(), chunk_bytes)):
                    row = (key_, n, start, len(data), base32(digest), digest.hex(), last)
                    out.append(row + (bytes(data),) if with_data else row)
                    held += len(data) if with_data else 100
                    if held > BATCH_BYTES:
                        yield packed(out)
                        out, held = [], 0
        if out:
            yield packed(out)

    schema = "key long, chunk int, start long, length long, running_digest string, running_sha1 string, last boolean"
    return rows.mapInArrow(task, schema + (", data binary" if with_data else ""))


def revisits(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, sha1, refers_to) of the rows that revisit the row of largest key with an equal payload."""
    ends = written(
        chunk_table(df, key, payload, with_data=False).where("last").select(
            "key", F.col("running_sha1").alias("sha1"), (F.col("start") + F.col("length")).alias("bytes")
        ),
        "warc-digests",
    ).where(F.col("bytes") >= min_bytes)
    groups = ends.groupBy("sha1").agg(F.max("key").alias("refers_to"), F.count("*").alias("n"))
    several = groups.where("n > 1 and refers_to is not null")
    both = lookup(ends, several, ["sha1"], "n")
    return both.where("key is null or key < refers_to").select("key", "sha1", "refers_to").distinct()


def _header(fields: dict) -> str:
    return "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)


def _record_id(key, digest: str, chunk: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}/{digest}/{chunk}')}>"


def records(key, url, payload, refers_to, opening: str, date: str, chunk_bytes: int):
    """The records of one row, without the line breaks that end each."""
    stream = list(_ends(payload, chunk_bytes))
    total, digest = stream[-1]
    uri = "".join(c for c in url if c.isprintable()) if url is not None else None
    common = {"WARC-Date": date, "WARC-Target-URI": uri, "X-Record-Key": key}
    if refers_to is None and total > chunk_bytes:  # tells the segments of repeated rows apart
        common["X-Stream-ID"] = uuid.uuid4()
    whole = {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": total}
    name = _record_id(key, digest)
    if refers_to is not None:
        fields = {"WARC-Type": "revisit", "WARC-Record-ID": name} | common | {
            "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Key": refers_to,
        }
        yield opening + _header(fields | whole | {"Content-Length": 0}) + "\r\n"
        return
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n"
    for n, (start, data, running, last) in enumerate(chunks_of(payload, chunk_bytes)):
        body = (http if n == 0 else "") + bytes(data).decode()
        size = len(data) + (len(http) if n == 0 else 0)
        if n == 0:
            fields = {"WARC-Type": "response", "WARC-Record-ID": name, "Content-Type": "application/http; msgtype=response"}
            fields |= common | whole | ({} if last else {"WARC-Segment-Number": 1})
        else:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": _record_id(key, digest, n)} | common | {
                "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n + 1,
                "WARC-Segment-Total-Length": total + len(http) if last else None, "X-Chunk-Start": start,
            }
        fields |= {} if last and n == 0 else {"X-Running-Digest": f"sha1:{base32(running)}"}
        yield opening + _header(fields | {"Content-Length": size}) + "\r\n" + body


def _ends(payload, chunk_bytes):
    for start, data, digest, last in chunks_of(payload, chunk_bytes):
        if last:
            yield start + len(data), base32(digest)


def write_archive(
    df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES, date: str = DATE, compression: str = "gzip",
) -> Archive:
    """Write one record per row below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the
    largest key are responses, the others (null keys included) revisit them; all
    other rows are responses. A null payload is empty, a null URL is left out.
    Repeated rows are written again.
    """
    archive = Archive(path, str(uuid.uuid4()))
    opening = archive.opening
    again = revisits(df, key, payload, min_bytes).select(
        F.col("key").alias("_key"), F.col("sha1").alias("_sha"), "refers_to"
    )
    again = written(again, "warc-revisits")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    if again.isEmpty():  # no payload has to move for a join
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        sha = F.sha1(F.encode(F.coalesce("payload", F.lit("")), "utf-8"))
        rows = rows.withColumn("_own", sha).join(again, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_sha")), "left")
    info = _header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{archive.token}>", "WARC-Date": date, "Content-Type": "application/warc-fields", "Content-Length": 0})

    def task(batches):
        out, held = [], 0
        for batch in batches:
            for key_, url_, text, other in zip(*(batch.column(i) for i in range(4))):
                for record in records(key_.as_py(), url_.as_py(), text.as_py(), other.as_py(), opening, date, chunk_bytes):
                    out.append(record)
                    held += len(record)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    lines = rows.select("key", "url", "payload", "refers_to").mapInArrow(task, "value string")
    ending = {"lineSep": "\r\n\r\n", "compression": compression}
    lines.write.options(**ending).text(f"{path}/records")
    df.sparkSession.createDataFrame([(f"{VERSION}\r\n{info}\r\n",)], "value string").coalesce(1).write.options(lineSep="\r\n\r\n").text(f"{path}/info")
    return archive


def open_archive(spark: SparkSession, path: str) -> Archive:
    """The archive below ``path``, its id taken from the warcinfo record."""
    first = spark.read.text(f"{path}/info", wholetext=True).first()[0]
    name = next(line for line in first.split("\r\n") if line.startswith("WARC-Record-ID:"))
    return Archive(path, name.partition("<urn:uuid:")[2].rstrip(">"))


def read_chunks(spark: SparkSession, archive: Archive, whole_data: bool = True) -> DataFrame:
    """The chunk table of an archive: one row per record, with its headers and bytes.

    ``whole_data`` False leaves the bytes of records of one chunk out and gives
    their digest instead. A record whose length differs from its header is an error.
    """
    separator = f"\r\n\r\n{archive.opening}"
    lines = spark.read.option("lineSep", separator).text(f"{archive.path}/records").select(F.col("value").cast("binary").alias("value"))
    opening = archive.opening.encode()
    names = ["record_id", "key", "url", "record_type", "refers_to", "chunk", "stream", "declared_bytes", "declared_digest", "running_digest", "length", "data"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def parsed(raw: bytes):
        raw = raw.removeprefix(opening)
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
        size = int(fields["Content-Length"])
        if len(block) == size + 4:  # the last record of a file keeps its ending
            block = block[:size]
        if len(block) != size:
            raise ValueError(f"record {fields['WARC-Record-ID']}: {len(block)} bytes instead of {size}")
        kind, number = fields["WARC-Type"], fields.get("WARC-Segment-Number")
        data = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        digest, running = (fields.get(n, "").removeprefix("sha1:") or None for n in ("WARC-Payload-Digest", "X-Running-Digest"))
        if kind == "response" and number is None and not whole_data:
            running, data, length = base32(hashlib.sha1(data).digest()), None, len(data)
        else:
            length = len(data)
        long_ = lambda n: int(fields[n]) if fields.get(n, "None") != "None" else None
        return (
            origin, long_("X-Record-Key"), fields.get("WARC-Target-URI"), kind, long_("X-Refers-To-Key"), int(number or 1) - 1,
            fields.get("X-Stream-ID"), long_("X-Payload-Length"), digest, running, length, data,
        )

    def task(batches):
        for batch in batches:
            out = [parsed(x.as_py()) for x in batch.column(0) if x.as_py().strip(b"\r\n")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = (
        "record_id string, key long, url string, record_type string, refers_to long, chunk int, stream string, "
        "declared_bytes long, declared_digest string, running_digest string, length long, data binary"
    )
    return lines.mapInArrow(task, schema)


def payloads(chunks: DataFrame) -> DataFrame:
    """(key, url, record_type, refers_to, payload_bytes, payload_digest), one row per record of the chunk table.

    The chunks of a record come to one task in their order and go through one
    running digest, whatever the payload's size. A digest, length or chunk number
    that differs from the headers is an error. Revisits have those of their payload.
    """
    names = ["record_id", "key", "url", "record_type", "refers_to", "chunk", "stream", "declared_bytes", "declared_digest", "running_digest", "length", "data"]
    single = F.col("stream").isNull()
    dealt = chunks.select(*[F.col(n) for n in names]).withColumn("data", F.when(~single, F.col("data"))).withColumn(
        "running_digest", F.coalesce("running_digest", F.when(single & (F.col("record_type") == "response"), F.lit("")))
    )
    ordered = dealt.repartition("record_id").sortWithinPartitions("record_id", "stream", "chunk")
    out_names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def task(batches):
        held = None  # of the record that is being read: first row, length, digest, next chunk

        def done():
            first, size, running, _ = held
            digest = base32(running.digest())
            if size != first[7] or digest != first[8]:
                raise ValueError(f"record {first[0]}: {size} bytes with digest {digest} instead of {first[7]} with {first[8]}")
            return first[1], first[2], "response", None, size, digest

        for batch in batches:
            out = []
            for row in zip(*(batch.column(i) for i in range(len(names)))):
                row = [x.as_py() for x in row]
                if held and row[5] == 0:
                    out.append(done())
                    held = None
                if row[6]:
                    if held is None:
                        held = (row, 0, hashlib.sha1(), 0)
                    if row[5] != held[3]:
                        raise ValueError(f"record {row[0]}: chunk {row[5]} where {held[3]} is due")
                    held[2].update(row[11])
                    if row[9] != base32(held[2].digest()):
                        raise ValueError(f"record {row[0]}: chunk {row[5]} is damaged")
                    held = (held[0], held[1] + row[10], held[2], held[3] + 1)
                elif row[3] == "revisit":
                    out.append((row[1], row[2], "revisit", row[4], row[7], row[8]))
                else:
                    if row[10] != row[7] or row[9] not in ("", row[8]):
                        raise ValueError(f"record {row[0]}: digest {row[9]} instead of {row[8]}")
                    out.append((row[1], row[2], "response", None, row[10], row[8]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=out_names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(), kinds)], names=out_names)

    return ordered.mapInArrow(
        task, "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    )


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the rows to an archive in the shared folder and read its records back."""
    archive = write_archive(df, scratch_path(df.sparkSession, "warc"), key, url, payload, chunk_bytes=chunk_bytes)
    return payloads(read_chunks(df.sparkSession, archive, whole_data=False))
