"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with some whole WARC records, then a skippable frame
with the seek table (compressed and plain size of each frame, frame count, magic number), so that any reader
of the seekable format can open it at a frame.  The index maps a record identifier to its bundle, frame and
the offset inside the frame.

Writers run in parallel, one bundle or more a task.  A task writes to a name of its own, and the index, which
Spark commits, names only bundles of tasks that succeeded; a repeated task leaves an unnamed bundle, no more.
Files go through the file system of their URI, so the folder may be any store that all executors share.

Defined cases: a null payload is empty; a null url is left out; control characters in a url are percent-
encoded; a null id is kept as such and never is the target of a revisit; rows that repeat both the id
and the payload of a response are responses too; a record larger than a frame has a frame of its own; other
columns are ignored; an empty table gives an empty index and no bundle.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import bounded_batches, gone_at_end, partitions, shared_folder, small, stored, tidied

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
INDEX_SCHEMA = "record_id string, bundle string, frame int, offset long, length long"
#: Repeated payloads whose digests (32 bytes) are broadcast at most; beyond it the join is shuffled.
BROADCAST_PAYLOADS = 400_000
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_uri(page_id: object) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{int(page_id)}>"


def encode_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC/1.1 record: headers, blank line, HTTP block, two line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_records(plain: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """Offset, length, headers and block of each record in a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(head["content-length"])
        yield at, end + 4 + n + 4 - at, head, plain[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class BundleWriter:
    """Groups records into frames and frames into bundles of a folder."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.out, self.name, self.sizes, self.buffer, self.waiting, self.written = None, "", [], io.BytesIO(), [], 0

    def add(self, record_id: str, record: bytes) -> list[tuple]:
        """The index entries of a frame, when this record fills it up."""
        done = self._flush() if self.buffer.tell() and self.buffer.tell() + len(record) > self.frame_bytes else []
        self.waiting.append((record_id, self.buffer.tell(), len(record)))
        self.buffer.write(record)
        return done

    def _flush(self) -> list[tuple]:
        if not self.waiting:
            return []
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            fs, path = _open(self.name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.sizes, self.written = fs.open_output_stream(path, compression=None), [], 0
        plain = self.buffer.getvalue()
        frame = zstandard.ZstdCompressor(level=3).compress(plain)
        self.out.write(frame)
        self.written += len(frame)
        done = [(i, self.name, len(self.sizes), at, n) for i, at, n in self.waiting]
        self.sizes.append((len(frame), len(plain)))
        self.buffer, self.waiting = io.BytesIO(), []
        if self.written >= self.bundle_bytes:
            self._end()
        return done

    def _end(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.out = None

    def close(self) -> list[tuple]:
        done = self._flush()
        if self.out is not None:
            self._end()
        return done


def seek_table(file) -> list[tuple[int, int, int]]:
    """Start, compressed size and plain size of each frame, from the footer."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * width)
    raw, out, at = file.read(count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, entry: tuple[int, int, int]) -> bytes:
    file.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(file.read(entry[1]), max_output_size=max(1, entry[2]))


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Per row: id, url, payload, revisit, refers_to.

    Equal payloads are found by SHA-256; the counts combine on the map side.  The payloads themselves aren't
    shuffled where the repeated digests are few enough to broadcast.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    repeated = rows.filter("key is not null").groupBy("key").agg(F.max("id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = stored(repeated, "warc-repeated")
    if small(repeated, BROADCAST_PAYLOADS):
        repeated = F.broadcast(repeated)
    revisit = F.col("largest").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("largest")))
    return rows.join(repeated, "key", "left").select("id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archive(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the records (of classify) as bundles of the folder; returns the index, stored for the session: write
    it beside the bundles to keep it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = BundleWriter(folder, frame_bytes, bundle_bytes)
        columns = ["record_id", "bundle", "frame", "offset", "length"]
        for batch in batches:
            done = []
            for page_id, url, payload, revisit, refers_to in zip(*(batch[c] for c in ("id", "url", "payload", "revisit", "refers_to")), strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                body = payload.encode()
                done += out.add(record_uri(page_id), encode_record(page_id, url, body, hashlib.sha1(body).hexdigest(), refers_to, bool(revisit)))
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(out.close(), columns=columns)

    bounded_batches(records.sparkSession)
    return stored(records.mapInPandas(write, INDEX_SCHEMA), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, read frame by frame and checked against its digest."""
    return _read(index.groupBy("bundle", "frame").agg(F.count("*").alias("records")), None)


def lookup(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records with the given record_id values; only the frames that hold them are read."""
    hits = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    return _read(hits.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets")), "offsets")


def _read(frames: DataFrame, offsets: str | None) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, file, table = "", None, []
        for batch in batches:
            for row in batch.sort_values(["bundle", "frame"]).itertuples(index=False):
                if row.bundle != opened:
                    fs, path = _open(row.bundle)
                    opened, file = row.bundle, fs.open_input_file(path)
                    table = seek_table(file)
                wanted = None if offsets is None else set(getattr(row, offsets))
                rows = []
                for at, _, head, block in decode_records(read_frame(file, table[row.frame])):
                    if wanted is not None and at not in wanted:
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    revisit, digest = head["warc-type"] == "revisit", head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if not revisit and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"damaged record {head['warc-record-id']} in {row.bundle}")
                    rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), digest, size, body))
                yield pd.DataFrame(rows, columns=["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"])

    bounded_batches(frames.sparkSession)
    # the few rows of frames stand for much data; the grouping's own partitions would be merged for their size
    dealt = frames.repartition(partitions(frames.sparkSession), F.xxhash64("bundle", "frame"))
    return dealt.mapInPandas(read, RECORD_SCHEMA)


@tidied
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, and give each page's record."""
    folder = shared_folder(spark, "warc")
    gone_at_end(spark, folder)
    index = write_archive(classify(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return read_archive(index).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP2_SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
