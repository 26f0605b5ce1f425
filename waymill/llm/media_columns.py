"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are the samples of an 8-bit grey image, 576 wide, stored
losslessly as PNG. Each task writes its images, one of each content, into tar shards in the shared folder, and begins a new shard at
SHARD bytes or ROWS rows. Members are named by the SHA-256 of the payload, shards by the SHA-256 of their members' names, so a task that
is run again writes the same shards over. The index (digest, shard, offset, length for each row) is written once, and where tasks stored
equal contents, all rows are pointed to the first of them; the other members stay unused. Metadata columns are filled by range reads of
the first 33 bytes of a member (signature and IHDR); payloads come back by a range read of the whole member, one at a time.

Null text counts as empty (one row of 255s); equal texts have equal values in all columns. Ids that are null or repeat are rows of their own.
"""

from __future__ import annotations

import hashlib
import io
import struct
import posixpath
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, rows

SHARD, ROWS = 1 << 28, 1 << 16  # bytes and rows after which a task begins a new shard
WIDTH, HEADER, MAGIC = 576, 33, b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, level: int = 4) -> bytes:
    """An 8-bit grey PNG of WIDTH columns; rows unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first HEADER bytes."""
    if first[:8] != MAGIC or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not the start of a PNG")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = header(data[:HEADER])
    at, packed = HEADER, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A 16-bin histogram of the samples and the mean absolute step between neighbours, in thousandths."""
    a = np.frombuffer(samples, np.uint8)
    step = int(np.abs(np.diff(a.astype(np.int16))).sum()) * 1000 // max(1, len(a) - 1)
    return ",".join(map(str, np.bincount(a >> 4, minlength=16))) + f";{step}"


STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*out, strict=True) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class Shard:
    """A tar file in the making, one member for each content."""

    def __init__(self, files: fs.FileSystem, folder: str) -> None:
        self.files, self.folder = files, folder
        self.part = f"{folder}/{uuid.uuid4().hex}.part"
        self.sink, self.pos = files.open_output_stream(self.part, compression=None), 0
        self.at: dict[bytes, tuple[int, int]] = {}  # digest: offset, length
        self.held: list[tuple[int | None, int, bytes]] = []

    def add(self, doc_id: int | None, n: int, data: bytes) -> None:
        digest = hashlib.sha256(data).digest()
        if digest not in self.at:
            image = to_png(data)
            info = tarfile.TarInfo(digest.hex() + ".png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.sink.write(head + image + b"\0" * (-len(image) % 512))
            self.at[digest] = self.pos + len(head), len(image)
            self.pos += len(head) + len(image) + -len(image) % 512
        self.held.append((doc_id, n, digest))

    def close(self) -> Iterator[pa.RecordBatch]:
        """Name the file by its content; the index rows of it."""
        self.sink.write(b"\0" * 1024)
        self.sink.close()
        name = f"{self.folder}/{hashlib.sha256(b''.join(self.at)).hexdigest()}.tar"
        if self.files.get_file_info(name).type == fs.FileType.NotFound:
            self.files.move(self.part, name)
        else:  # the same members in the same order, so the same file
            self.files.delete_file(self.part)
        for i in range(0, len(self.held), 4096):
            yield _batch([(d, n, g.hex(), name, *self.at[g]) for d, n, g in self.held[i : i + 4096]], _STORED)

    def drop(self) -> None:
        self.sink.close()
        self.files.delete_file(self.part)


def store(docs: DataFrame, root: str | None = None, size: int = SHARD, most: int = ROWS) -> DataFrame:
    """Write the payloads of docs(doc_id, text) into tar shards under root (a URI; the shared folder by default): STORED, a row each, as written;
    rows of one content in several shards are not settled yet. Each evaluation writes, so materialize the result."""
    root = root or fresh_path(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(root)
        files.create_dir(folder, recursive=True)
        shard = None
        try:
            for batch in rows(batches, 1 << 22):
                for doc_id, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")), strict=True):
                    shard = shard or Shard(files, folder)
                    shard.add(doc_id.as_py(), *payload(text.as_py())[::-1])
                    if shard.pos >= size or len(shard.held) >= most:
                        yield from shard.close()
                        shard = None
            if shard:
                yield from shard.close()
                shard = None
        finally:
            if shard:
                shard.drop()

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(write, STORED)


def settled(stored: DataFrame) -> DataFrame:
    """STORED with all rows of a content at the first place it has. Only contents in several shards are moved, dealt out by digest and shard."""
    places = stored.select("digest", "shard", "offset", "length").distinct()
    first = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("first"), F.count("*").alias("n")).where("n > 1")
    moved = materialize(places.join(first, "digest").where("shard <> first.shard").select("digest", "shard", "first"), "media-moved")
    out = stored.join(moved, ["digest", "shard"], "left")
    at = [F.coalesce(F.col("first")[c], F.col(c)).alias(c) for c in ("shard", "offset", "length")]
    return out.select("doc_id", "n_bytes", "digest", *at)


def _reads(batches: Iterator[pa.RecordBatch], root: str, whole: bool, at_once: int = 1024) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    files, folder = fs.FileSystem.from_uri(root)

    def each(batch: pa.RecordBatch) -> Iterator[bytes]:
        name, source = None, None
        for shard, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if shard != name:
                if source:
                    source.close()
                name, source = shard, files.open_input_file(posixpath.join(folder, posixpath.basename(shard)))
            yield source.read_at(length if whole else HEADER, offset)
        if source:
            source.close()

    for batch in batches:
        for low in range(0, batch.num_rows, at_once):
            part = batch.slice(low, at_once)
            yield part, each(part)


def metadata(stored: DataFrame, root: str) -> DataFrame:
    """STORED and width, height, depth, by range reads of headers only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _reads(batches, root, False):
            heads = [header(x) for x in got]
            cols = zip(*heads, strict=True) if heads else [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*batch.schema.names, "width", "height", "depth"])

    return stored.mapInArrow(read, STORED + ", width long, height long, depth long")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width long, height long"
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("width", pa.int64()), ("height", pa.int64())])


def read_back(stored: DataFrame, root: str) -> DataFrame:
    """READ: digests and features of what is stored, each payload read by one range read and decoded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _reads(batches, root, True):
            out = []
            seen: dict[int, tuple] = {}
            d = batch.to_pydict()
            for i, image in enumerate(got):
                key = d["shard"][i], d["offset"][i]
                if key not in seen:
                    data = from_png(image)
                    seen[key] = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(data))
                out.append((d["doc_id"][i], d["n_bytes"][i], *seen[key], d["shard"][i], d["offset"][i], d["width"][i], d["height"][i]))
            yield _batch(out, _READ)

    return stored.mapInArrow(read, READ)


def media_table(docs: DataFrame) -> DataFrame:
    """READ for every row of docs: stored, headers read, payloads read back."""
    root = fresh_path(docs.sparkSession, "media")
    index = settled(materialize(store(docs, root), "media-stored"))
    return read_back(metadata(index, root), root)
