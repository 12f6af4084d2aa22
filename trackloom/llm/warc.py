"""WARC archives as tables of chunks.

Writing: payloads are cut into chunk rows by Spark (record, chunk number, bytes), which each task streams into one archive in
a folder that all executors share; no whole record enters Python, and the length and digest that a record's head needs come as columns. A task
reports its archive as a manifest row; only archives in the (written) manifest count, so a repeated task leaves nothing
double. Of records with equal payloads of at least `least_bytes` one is a response, the others are revisits that name it. Which
one is found by digest and length in an aggregation, so a payload that a third of all pages share is one row per task before
it is shuffled, and by digests alone: payloads are never dealt by their digest.

Reading: archives are streamed. A payload comes as rows of record id and chunk number, each with the running length
and the running SHA-1 of all chunks so far; no more than a chunk of a payload is held, however long the record is.

Paths are opened by Arrow's file systems (file, hdfs, s3, gs). Defined results: a null payload is empty, and empty
payloads are responses; repeated page ids are written as often as they occur, and a record's id names page and payload, so that a
revisit is resolved to the payload it had; rows that repeat the largest id and a payload are all responses; null page ids are written as responses and read
back as null; null urls are written as empty; an empty table gives an archive without records and an empty result; extra
columns are ignored; a head line of more than `LONGEST_LINE` bytes is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm._common import materialize, new_path, text_or_empty

CHUNK, LEAST_BYTES, LONGEST_LINE = 1 << 20, 1000, 1 << 26
PAGE_PATTERN = r"^urn:page:(-?\d*):"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, write: bool):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_stream(path, buffer_size=CHUNK)


class _Record:
    """One record as one gzip member, as archives have them, so that each can be read alone. Its payload comes by chunks."""

    def __init__(self, out: BinaryIO, fields: list[tuple[str, str]], length: int):
        self.out, self.pressed = out, zlib.compressobj(1, wbits=31)
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {length}\r\n\r\n"
        out.write(self.pressed.compress(head.encode()))

    def add(self, data) -> None:
        self.out.write(self.pressed.compress(data))

    def close(self) -> None:
        self.out.write(self.pressed.compress(b"\r\n\r\n") + self.pressed.flush())


def _record_id(page: int | None, sha1: str) -> str:
    """Of a page with this payload. Rows that repeat both are one record, written as often."""
    return f"urn:page:{'' if page is None else page}:{sha1}"


def _one_line(value: str) -> str:
    return "".join(c if c not in "\r\n" else " " for c in value)


def choose_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (text), target: the page that this one revisits, null for responses."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), text_or_empty(F.col(f"`{payload_col}`")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("h", F.unhex(F.sha2("payload", 256)))
    marks = rows.select("page_id", "h", "n").where(F.col("n") >= least_bytes)
    first = marks.groupBy("h", "n").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    revisits = marks.join(first, ["h", "n"]).where("page_id <> best").select(F.col("page_id").alias("p2"), F.col("h").alias("h2"), F.col("best").alias("target")).distinct()
    found = rows.join(revisits, (F.col("page_id") == F.col("p2")) & (F.col("h") == F.col("h2")), "left")
    return found.select("page_id", "url", "payload", "target")


def payload_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records(page_id, url, payload, target) -> page_id, url, target, length, sha1, chunk, last, data: the rows of a record one after the other."""
    body = records.withColumn("payload", F.col("payload").cast("binary"))
    length = F.when(F.col("target").isNull(), F.octet_length("payload")).otherwise(0).cast("long")
    heads = body.select("page_id", "url", "target", "payload", length.alias("length"), F.sha1("payload").alias("sha1"))
    most = F.greatest(F.ceil(F.col("length") / chunk) - 1, F.lit(0)).cast("int")
    rows = heads.select("*", most.alias("most"), F.explode(F.sequence(F.lit(0), most)).alias("chunk"))
    data = F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))
    return rows.select("page_id", "url", "target", "length", "sha1", "chunk", (F.col("chunk") == F.col("most")).alias("last"), F.when(F.col("length") > 0, data).alias("data"))


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """records(page_id, url, payload, target) -> the manifest (path, records, bytes), a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, record = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        with _open(path, True) as out:
            note = b"format: WARC File Format 1.1\r\n"
            record = _Record(out, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], len(note))
            record.add(note)
            record.close()
            for batch in batches:
                data = batch.column(7)
                heads = zip(*(c.to_pylist() for c in batch.columns[:7]))
                for i, (page, url, target, length, sha1, k, last) in enumerate(heads):
                    if k == 0:
                        fields = [("WARC-Type", "response" if target is None else "revisit"), ("WARC-Record-ID", f"<{_record_id(page, sha1)}>"), ("WARC-Target-URI", _one_line(url or "")), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
                        if target is not None:
                            fields += [("WARC-Refers-To", f"<{_record_id(target, sha1)}>"), ("WARC-Profile", REVISIT_PROFILE)]
                        record = _Record(out, fields, length)
                        n += 1
                    if data[i].is_valid:
                        record.add(data[i].as_buffer())
                    if last:
                        record.close()
            size = out.tell()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return materialize(payload_chunks(records, chunk).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class _Source:
    """Lines and exact lengths from a stream, by blocks."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.held, self.at = stream, b"", 0

    def fill(self, n: int) -> bool:
        if len(self.held) - self.at >= n:
            return True
        more = self.stream.read(max(n, CHUNK))
        self.held, self.at = self.held[self.at :] + more, 0
        return len(self.held) >= n

    def line(self) -> bytes:
        while True:
            end = self.held.find(b"\r\n", self.at)
            if end >= 0:
                out, self.at = self.held[self.at : end], end + 2
                return out
            n = len(self.held) - self.at
            if n > LONGEST_LINE:
                raise ValueError(f"a head line is longer than {LONGEST_LINE} bytes")
            if not self.fill(n + 1):
                out, self.at = self.held[self.at :], len(self.held)
                return out

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def stream_chunks(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of a WARC stream: type, record_id, target, url, chunk, data, length_so_far, sha1_so_far, last."""
    source = _Source(stream)
    while source.fill(1):
        if not source.line().startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        fields = {}
        while line := source.line():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        left, k, seen, digest = int(fields["content-length"]), 0, 0, hashlib.sha1()
        while True:
            data = source.take(min(chunk, left - seen))
            seen += len(data)
            digest.update(data)
            if seen < left and not data:
                raise ValueError("the archive ends within a record")
            yield {"type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"), "target": fields.get("warc-refers-to", "").strip("<>") or None, "url": fields.get("warc-target-uri"), "chunk": k, "data": data, "length_so_far": seen, "sha1_so_far": digest.hexdigest(), "last": seen == left}
            k += 1
            if seen == left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end as it should")


def read_chunks(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives in manifest(path, ...); without data only lengths and digests."""
    names = ["type", "record_id", "target", "url", "chunk", "length_so_far", "sha1_so_far", "last"] + ["data"] * with_data
    kinds = {"chunk": pa.int64(), "length_so_far": pa.int64(), "last": pa.bool_(), "data": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path, False) as packed, gzip.GzipFile(fileobj=packed, mode="rb") as stream:
                    rows, size = [], 0
                    for row in stream_chunks(stream, chunk):
                        size += len(row["data"]) if with_data else 200
                        rows.append([row[n] for n in names])
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "type string, record_id string, target string, url string, chunk long, length_so_far long, sha1_so_far string, last boolean" + ", data binary" * with_data
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, ddl)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response it names, found among the records read.
    """
    spark = pages.sparkSession
    manifest = write_archives(choose_revisits(pages, id_col, url_col, payload_col, least_bytes), folder or new_path(spark, "warc"), chunk)
    ends = read_chunks(spark, manifest, chunk, with_data=False).where("last and type <> 'warcinfo'")
    page = F.regexp_extract("record_id", PAGE_PATTERN, 1).try_cast("long")
    target = F.regexp_extract("target", PAGE_PATTERN, 1).try_cast("long")
    ends = materialize(ends.select("record_id", "target", page.alias("page_id"), F.col("type").alias("record_type"), target.alias("refers_to"), F.col("length_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest")), "warc-records")
    named = ends.where("record_type = 'revisit'").select(F.col("target").alias("id")).distinct()
    known = ends.where("record_type = 'response'").join(named, F.col("record_id") == F.col("id"), "left_semi").groupBy(F.col("record_id").alias("id")).agg(F.min("payload_bytes").alias("b"), F.min("payload_digest").alias("d"))
    found = ends.join(known, F.col("target") == F.col("id"), "left")
    return found.select("page_id", F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
