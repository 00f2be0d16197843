"""WARC records in seekable Zstandard bundles: independent frames, a seek table at the end, an index of records.

A bundle is a file of Zstandard frames of about ``frame_bytes`` of records each, then a skippable frame with the seek
table of the public seekable format (compressed and plain size of every frame, their number, the magic number). The
index has a row for each record: its id, the bundle, the frame, and offset and length in the plain frame; so one
record is read by decompressing one frame.

Each task writes bundles under names of its own attempt and tells them in the index. The index is written as a table
once; bundles of lost or repeated attempts are in no index and are never read.

Payloads are UTF-8. Of pages with equal payloads (of ``least_bytes`` at least) the one with the smallest page id is a
response and the others are revisits that refer to it, without a payload of their own. Defined cases: a null payload
is empty; very long payloads are a frame of their own; other columns are left out; a null URL has no target header; control characters of a URL are percent-encoded in its header; repeated
pages with the smallest id are all responses; a null page id is written as such and refers to its group's smallest id,
or is a response where there is none; an empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_folder, written

#: Numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits up to this many are broadcast to the writers (about 100 bytes each); more are joined by a shuffle.
BROADCAST_REVISITS = 100_000
SALTS = 16
INDEX = "record_id string, path string, frame int, at long, length long"


class BundleWriter:
    """Collects records into frames and ends the file with the seek table."""

    def __init__(self, sink, frame_bytes: int, level: int = 3) -> None:
        self.sink, self.frame_bytes, self.squeeze = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.total = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record in it."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.end_frame()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def end_frame(self) -> None:
        if self.held:
            packed = self.squeeze.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.total += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Frames of a bundle by number."""

    def __init__(self, source) -> None:
        self.source, self.expand = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("the file doesn't end with a seek table")
        source.seek(size - 9 - 8 * count)
        table = source.read(8 * count)
        self.frames, at = [], 0
        for n in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * n)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        self.source.seek(at)
        return self.expand.decompress(self.source.read(packed), max_output_size=plain)


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_id(identifier: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d*)>", identifier or "")
    return int(digits[1]) if digits and digits[1] else None


def record(page, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    size = int(headers["Content-Length"])
    return headers, data[begin : begin + size], begin + size + 4


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(page, digest, refers_to) of the pages that are not the first with their payload, without repeats."""
    payload = F.coalesce(payload_col, F.lit(""))
    narrow = pages.where(F.octet_length(payload) >= least_bytes).select(F.col(id_col).alias("page"), F.sha1(payload.cast("binary")).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    # a payload may be on most pages (the empty one): its pages meet their first one in SALTS tasks
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    return salted.join(first, ["digest", "salt"]).where("NOT page <=> refers_to").select("page", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages into bundles in ``folder`` (a new one in the shared folder) and returns the index, a table."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    again = written(revisits(pages, id_col, payload_col, least_bytes), "warc-revisits")
    if again.count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    rows = rows.alias("p").join(again.alias("r"), F.expr("p.page <=> r.page AND p.digest = r.digest"), "left").select("p.*", "r.refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        names = [c.split()[0] for c in INDEX.split(", ")]
        bundle, path = None, ""
        for batch in batches:
            found = []
            for page, url, text, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(where.open_output_stream(path, compression=None), frame_bytes)
                printed = base64.b32encode(bytes.fromhex(digest)).decode()
                made = record(page, url, text.encode("utf-8", "surrogatepass"), printed, refers_to, refers_to is not None, date)
                found.append((record_id(page), path, *bundle.add(made), len(made)))
                if bundle.total >= bundle_bytes:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=names).astype({"frame": "int32", "at": "int64", "length": "int64"}), preserve_index=False)
        if bundle is not None:
            bundle.close()

    index = rows.mapInArrow(run, INDEX).withColumn("folder", F.lit(folder))
    return written(index, "warc-index")


RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't have its digest")
    size = len(payload) if payload is not None else int(headers["X-Payload-Length"])
    own = headers["WARC-Record-ID"]
    return own, page_id(own), headers.get("WARC-Target-URI"), kind, page_id(headers.get("WARC-Refers-To")), size, digest, payload


def _frame_rows(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return found.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles that the index names, read back from the files."""
    paths = index.select("folder", "path").distinct()
    paths = paths.repartition(max(1, paths.count()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, path in zip(batch.folder, batch.path):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as source:
                    bundle = BundleReader(source)
                    for n in range(len(bundle.frames)):
                        data, at, rows = bundle.frame(n), 0, []
                        while at < len(data):
                            headers, block, at = parse(data, at)
                            rows.append(_row(headers, block))
                        if not with_payload:
                            rows = [(*r[:-1], None) for r in rows]
                        yield _frame_rows(rows)

    return paths.mapInPandas(run, RECORD)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ids are in the column ``record_id`` of ``wanted``: only their frames are decompressed."""
    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").repartition("path", "frame").sortWithinPartitions("path", "frame", "at")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (folder, path), some in batch.groupby(["folder", "path"], sort=False):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as source:
                    bundle = BundleReader(source)
                    for n, inside in some.groupby("frame", sort=False):
                        data = bundle.frame(int(n))
                        yield _frame_rows([_row(*parse(data, int(at))[:2]) for at in inside["at"]])

    return places.mapInPandas(run, RECORD)
