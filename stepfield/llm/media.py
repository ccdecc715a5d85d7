"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

`store_media` writes each task's payloads to tar shards of its own in the shared folder and returns one row per document.
A member is named by the digest of its bytes and stored once per shard set of a task, so a text copied into a third of all
rows costs one member per task and no shuffle. Task attempts never share a file: rows of a successful attempt name its own
shards, and what a lost executor left behind is not referenced. `read_headers` fills metadata columns by range reads of the
first 33 bytes of a member; `read_payloads` reads whole members, checks them against the digest and computes features.

Payload: UTF-8 bytes, padded with spaces to a positive multiple of 192, kept as an RGB PNG of width 64 (lossless).
Defined cases: null text is empty (192 spaces); long texts make high images, never cut; repeated rows and equal texts give
equal values; a null doc_id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stepfield.llm.common import bounded_batches, scratch, written

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: A task starts another shard beyond this size; digests that a task remembers to store equal contents once.
SHARD_BYTES, REMEMBERED = 1 << 30, 200_000
INDEX = "doc_id long, n_bytes long, media_sha256 string, shard string, offset long, length long"


def pad(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % ROW or (0 if data else ROW))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """The payload as the samples of an 8-bit RGB image of width 64, rows unfiltered."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG member")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(media: bytes) -> bytes:
    """The samples of an image made by encode_png."""
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean sample and an 8-bin histogram (parts per 10,000) of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8) * 10_000 // len(samples)
    return f"{width}x{height}|{samples.mean():.4f}|" + ",".join(map(str, bins))


class _Shards:
    """The tar shards that one task attempt writes."""

    def __init__(self, folder: str):
        context = TaskContext.get()
        self.stem = f"{folder}/{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}"
        self.count, self.out, self.at = 0, None, 0

    def add(self, name: str, media: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.uri = f"{self.stem}-{self.count}.tar"
            files, path = fs.FileSystem.from_uri(self.uri)
            files.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out, self.at, self.count = files.open_output_stream(path), 0, self.count + 1
        info = tarfile.TarInfo(name)
        info.size = len(media)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head + media + b"\0" * (-len(media) % 512))
        place = (self.uri, self.at + len(head), len(media))
        self.at += len(head) + len(media) + (-len(media) % 512)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store_media(docs: DataFrame, name: str = "media") -> DataFrame:
    """docs (doc_id, text) -> the written index (INDEX columns), one row per document. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch(spark, f"{name}-shards")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder), {}
        try:
            for batch in batches:
                out = []
                for data in batch.column(1).cast(pa.binary()).to_pylist():
                    data = data or b""
                    payload = pad(data)
                    key = hashlib.sha256(payload).digest()
                    if key not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        media = encode_png(payload)
                        digest = hashlib.sha256(media).hexdigest()
                        seen[key] = (digest, *shards.add(f"{digest}.png", media))
                    out.append((len(data), *seen[key]))
                columns = zip(*out, strict=True) if out else [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "media_sha256", "shard", "offset", "length"])
        finally:
            shards.close()

    return written(docs.select("doc_id", "text").mapInArrow(store, INDEX), f"{name}-index")


def _ranges(batch: pa.RecordBatch, opened: dict, length: int | None = None) -> Iterator[bytes]:
    """For each index row the bytes of its member, or the first `length` of them; `opened` keeps the last shard open."""
    shard, offset, size = (batch.column(c).to_pylist() for c in ("shard", "offset", "length"))
    for uri, at, n in zip(shard, offset, size, strict=True):
        if uri not in opened:
            for old in opened.values():
                old.close()
            opened.clear()
            files, path = fs.FileSystem.from_uri(uri)
            opened[uri] = files.open_input_file(path)
        yield opened[uri].read_at(n if length is None else min(n, length), at)


def read_headers(index: DataFrame) -> DataFrame:
    """index with width, height, bit_depth and colour_type, from range reads of the members' headers alone."""

    def read(batches):
        opened: dict = {}
        for batch in batches:
            got = [png_header(head) for head in _ranges(batch, opened, HEADER_BYTES)]
            columns = list(zip(*got, strict=True)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, "width", "height", "bit_depth", "colour_type"])

    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)
    return index.mapInArrow(read, f"{schema}, width long, height long, bit_depth long, colour_type long")


def read_payloads(index: DataFrame) -> DataFrame:
    """index with payload_bytes, payload_sha256, tail_crc32, media_bytes and feature, computed from the members' bytes.
    Raises if a member doesn't match its digest."""

    def read(batches):
        opened: dict = {}
        for batch in batches:
            out, seen = [], {}
            for digest, media in zip(batch.column("media_sha256").to_pylist(), _ranges(batch, opened), strict=True):
                if digest not in seen:
                    if hashlib.sha256(media).hexdigest() != digest:
                        raise ValueError(f"member {digest} is damaged")
                    payload = decode_png(media)
                    width, height, *_ = png_header(media)
                    seen[digest] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), feature(payload, width, height))
                out.append(seen[digest])
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)
    return index.mapInArrow(read, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")
