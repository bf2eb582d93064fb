"""WARC records in seekable Zstandard bundles.

Each task groups its records into frames of about ``FRAME`` bytes, every frame a Zstandard
frame of its own, and frames into bundle files of about ``BUNDLE`` bytes. A bundle ends with
the footer of the seekable format: a skippable frame with the sizes of all frames, so any frame is
found with two small reads, and any Zstandard reader still unpacks the whole. The index maps
record ids to bundle, frame and the offset inside the unpacked frame.

A payload of at least ``LEAST`` bytes is stored once, in the record of the largest page id; its
other holders become revisit records that name it. Files go to a folder that the cluster
shares, under a name no other attempt of the task has. Only the index of the attempt that
counts is kept, so a repeated task leaves a file that nothing refers to.

Defined results: a null payload is empty; a null page id counts as the smallest and leaves its
number out of the record id. All rows that have the largest id of their payload are
responses. A null target leaves its header out; line breaks in it become spaces.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regdata.llm.arrow import column, share_code
from regdata.llm.few import with_marks
from regdata.operators.skew import spread_out
from regdata.session import materialise, shared_folder

FRAME, BUNDLE = 1 << 18, 1 << 26
LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
# Magic numbers of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, file string, frame int, offset long, length long"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer for frames of the given packed and unpacked sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(file, size: int) -> list[tuple[int, int]]:
    """Packed and unpacked sizes of a bundle's frames, from its end."""
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    return list(struct.iter_unpack("<II", file.read(8 * count)))


def record_id(page: int | None, digest: str) -> str:
    return f"urn:page:{'' if page is None else page}:{digest}"


def record(page, url, payload: bytes, digest: str, first) -> tuple[str, bytes]:
    """Id and bytes of one record; ``first`` is the page a revisit refers to."""
    name = record_id(page, digest)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.splitlines())}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if first is None:
        head.append("Content-Type: application/http; msgtype=response")
        block = http + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(first, digest)}>"]
        block = b""
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_in(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an unpacked frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        end = stop + 4 + int(headers["Content-Length"])
        yield at, end + 4 - at, headers, data[stop + 4 : end]
        at = end + 4


class Bundle:
    """One file that frames are appended to."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = fs.FileSystem.from_uri(self.uri)
        self.out, self.sizes, self.written = system.open_output_stream(path, compression=None), [], 0
        self.pack = zstandard.ZstdCompressor(level=3).compress

    def add(self, frame: bytes) -> None:
        packed = self.pack(frame)
        self.out.write(packed)
        self.sizes.append((len(packed), len(frame)))
        self.written += len(packed)

    def close(self) -> None:
        self.out.write(seek_table(self.sizes))
        self.out.close()


def write_archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages as records; returns the index of where each record is."""
    session = pages.sparkSession
    folder = folder or f"{shared_folder(session)}/warc-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    share_code(session)
    body = F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("_page"), F.col(url).cast("string").alias("_url"), body.alias("_body"))
    rows = rows.withColumn("_digest", F.sha1("_body"))
    groups = rows.where(F.octet_length("_body") >= LEAST).groupBy("_digest").agg(F.max("_page").alias("_first"), F.count(F.lit(1)).alias("_times"))
    groups = materialise(groups.where("_times > 1 and _first is not null").select("_digest", "_first"))
    rows = with_marks(rows, groups, ["_digest"]).withColumn("_first", F.when(F.coalesce(F.col("_page"), F.lit(-(2**63))) != F.col("_first"), F.col("_first")))

    def run(batches):
        bundle, frame, size, where = None, [], 0, []

        def flush():
            nonlocal bundle, frame, size
            if frame:
                bundle = bundle or Bundle(folder)
                bundle.add(b"".join(frame))
                frame, size = [], 0

        def rows_of():
            names = ["record_id", "file", "frame", "offset", "length"]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*where), kinds)], names)

        for batch in batches:
            for page, link, data, digest, first in zip(*[column(batch, c) for c in ("_page", "_url", "_body", "_digest", "_first")]):
                name, text = record(page.as_py(), link.as_py(), data.as_py(), digest.as_py(), first.as_py())
                bundle = bundle or Bundle(folder)
                where.append((name, bundle.uri, len(bundle.sizes), size, len(text)))
                frame.append(text)
                size += len(text)
                if size >= FRAME:
                    flush()
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
                    yield rows_of()
                    where.clear()
        flush()
        if bundle:
            bundle.close()
        if where:
            yield rows_of()

    return materialise(rows.mapInArrow(run, INDEX))


def frame_table(index: DataFrame) -> DataFrame:
    """Place of every frame of the bundles, read off their seek tables: ``file``, ``frame``, ``start``, ``packed``."""
    share_code(index.sparkSession)

    def run(batches):
        for batch in batches:
            for uri in column(batch, "file").to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    packed = np.array([p for p, _ in frames_of(f, f.size())], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(packed)), pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(np.cumsum(packed) - packed), pa.array(packed)],
                    ["file", "frame", "start", "packed"],
                )

    return index.select("file").distinct().mapInArrow(run, "file string, frame int, start long, packed long")


RECORD = "record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def parsed(data: bytes) -> pa.RecordBatch:
    """The records of a piece of an unpacked frame."""

    def page_of(name: str | None) -> int | None:
        number = name.strip("<>").split(":")[2] if name else ""
        return int(number) if number else None

    rows = []
    for _, _, h, block in records_in(data):
        kind = h["WARC-Type"]
        body = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        digest = hashlib.sha1(body).hexdigest() if body is not None else h["WARC-Payload-Digest"].removeprefix("sha1:")
        length = len(body) if body is not None else int(h["Payload-Length"])
        name = h["WARC-Record-ID"].strip("<>")
        rows.append((name, page_of(name), h.get("WARC-Target-URI"), kind, body, length, digest, page_of(h.get("WARC-Refers-To"))))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_frames(frames: DataFrame) -> DataFrame:
    """All records of the given frames; a revisit has no payload of its own, and the size and digest its header names."""
    share_code(frames.sparkSession)

    def run(batches):
        for batch in batches:
            for uri, start, packed in zip(*[column(batch, c).to_pylist() for c in ("file", "start", "packed")]):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    f.seek(start)
                    data = zstandard.ZstdDecompressor().decompress(f.read(packed))
                yield parsed(data)

    # a frame's row is tiny, what it names is not: without this adaptive execution puts all into one task
    return spread_out(frames, "file", "frame").mapInArrow(run, RECORD)


def find_records(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Records by id: only the frames that hold them are read and unpacked, up to the last of them, and only they are parsed.

    Unknown and null ids find nothing; an id that is asked for twice is found once.
    """
    share_code(index.sparkSession)
    wanted = index.join(ids.select("record_id").distinct(), "record_id")
    spots = wanted.groupBy("file", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spots"))
    frames = frame_table(wanted).join(spots, ["file", "frame"])

    def run(batches):
        for batch in batches:
            for uri, start, packed, at in zip(*[column(batch, c).to_pylist() for c in ("file", "start", "packed", "spots")]):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    f.seek(start)
                    data = f.read(packed)
                done, reader = 0, zstandard.ZstdDecompressor().stream_reader(data)
                for spot in at:
                    reader.read(spot["offset"] - done)
                    yield parsed(reader.read(spot["length"]))
                    done = spot["offset"] + spot["length"]

    return spread_out(frames, "file", "frame").mapInArrow(run, RECORD)
