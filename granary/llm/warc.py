"""WARC archives as seekable Zstandard bundles.

Each task writes its pages as WARC records into bundles in the shared folder.  A bundle is a row
of independent Zstandard frames of about a megabyte of records, closed by a seek table in a
skippable frame: the compressed and plain size of every frame, the number of frames and a magic
number, so that any Zstandard reader can read the bundle whole and this one can go to a frame
alone.  The index table maps record ids to (bundle, frame, offset in the frame, length); it is
written by Spark once, and only bundles that it names count, so a task that runs again or twice
leaves at most a file that nothing refers to.

Payloads that occur again are stored once: of equal payloads of at least ``SMALL`` bytes the record
with the largest id is the response, the others are revisits that refer to it and hold no payload.

Defined results: null html is the empty payload; rows with equal id and payload are all response
when that id is the largest; null ids never become the response while an id exists; the URL's
white space and control characters are percent-encoded, a null URL is left out.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.prefix import materialise, work_folder

SMALL = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Bytes of records that one task reads back, about.
READ_BYTES = 32 << 20
LEVEL = 3
#: Time stamp of all records: the table has none, and equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*:/", folder) else (fs.LocalFileSystem(), folder)


class BundleWriter:
    """Writes records into frames and frames into one file."""

    def __init__(self, folder: str):
        self.fs, root = _open(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.fs.create_dir(root, recursive=True)
        self.file = self.fs.open_output_stream(posixpath.join(root, self.name), compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.size = 0
        self.held: list[bytes] = []
        self.filled = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.held and self.filled + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.filled
        self.held.append(record)
        self.filled += len(record)
        return at

    def flush(self) -> None:
        if not self.held:
            return
        packed = self.packer.compress(b"".join(self.held))
        self.file.write(packed)
        self.frames.append((len(packed), self.filled))
        self.size += len(packed)
        self.held, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.file.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        files, root = _open(folder)
        self.file = files.open_input_file(posixpath.join(root, name))
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, size - 9 - 8 * count))
        self.at, self.frames = 0, []
        for packed, plain in zip(table[::2], table[1::2]):
            self.frames.append((self.at, packed, plain))
            self.at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.unpacker.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; ``payload`` is left out of a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {DATE}", f"X-Page-ID: {'' if page is None else page}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> dict:
    """Fields of the record at ``at`` and, for a response, its payload."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start, size = end + 4, int(fields["Content-Length"])
    block = data[start:start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    return {
        "type": fields["WARC-Type"], "page": fields["X-Page-ID"], "url": fields.get("WARC-Target-URI"), "digest": digest,
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length,
        "refers_to": fields.get("X-Refers-To-Page"), "end": start + size + 4,
    }


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors see; removed when the application ends."""
    return work_folder(spark, "warc")


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes the archives; returns the index (page_id, bundle, frame, offset, length)."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Only payloads that occur again need a decision.
    again = materialise(
        rows.filter(F.length("payload") >= SMALL).groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "response")
    )
    revisits = (F.length("payload") >= SMALL) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    decided = rows.join(again, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits, F.col("response")).alias("refers_to")
    )
    names = ["page_id", "bundle", "frame", "offset", "length"]

    def run(batches):
        writer = None
        try:
            for b in batches:
                at = []
                for page, url, payload, digest, refers_to in zip(*(b[c].to_pylist() for c in b.schema.names)):
                    if writer is None:
                        writer = BundleWriter(folder)
                    data = record(page, url, payload, digest, refers_to)
                    at.append((page, writer.name, *writer.add(data), len(data)))
                    if writer.size >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                if at:
                    columns = [pa.array(list(c), t) for c, t in zip(
                        zip(*at), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                    )]
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            if writer is not None:
                writer.close()

    return materialise(decided.mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long"))


def read(index: DataFrame, folder: str) -> DataFrame:
    """Records of an index: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).

    ``payload_digest`` and ``payload_bytes`` of a response are taken from the payload that was read.
    Frames are dealt out to as many tasks as their bytes need, so a bundle is read by many tasks, each of
    them seeking to its frames.
    """
    # The index is small beside what it names, so adaptive execution must not choose the number of tasks.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + size // READ_BYTES
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def run(batches):
        for b in batches:
            readers: dict[str, BundleReader] = {}
            for bundle, frame, offsets in zip(*(b[c].to_pylist() for c in ("bundle", "frame", "offsets"))):
                if bundle not in readers:
                    for old in readers.values():
                        old.close()
                    readers = {bundle: BundleReader(folder, bundle)}
                data = readers[bundle].frame(frame)
                out = {k: [] for k in ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")}
                for at in offsets:
                    r = parse(data, at)
                    whole = r["payload"]
                    if whole is not None and (hashlib.sha1(whole).hexdigest() != r["digest"] or len(whole) != r["payload_bytes"]):
                        raise ValueError(f"payload of record {r['page']} in {bundle} is damaged")
                    out["page_id"].append(int(r["page"]) if r["page"] else None)
                    out["url"].append(r["url"])
                    out["record_type"].append(r["type"])
                    out["payload_bytes"].append(r["payload_bytes"])
                    out["payload_digest"].append(r["digest"])
                    out["refers_to"].append(int(r["refers_to"]) if r["refers_to"] else None)
                    out["payload"].append(whole)
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))
            for old in readers.values():
                old.close()

    return frames.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(
        run,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    )
