"""Media columns: content-addressed payloads in tar shards of the shared folder.

A payload is stored as an 8-bit greyscale PNG (192 samples a row, lossless). Each
task writes its payloads into tar shards, one member per distinct content and
shard, named by the SHA-256 of the stored bytes. Rows carry that digest with
shard, offset and length; the index is a table. Metadata columns are filled by
range reads of the first 33 bytes of each member only. A shard is written under
a name of its own attempt and renamed when it is complete, so a repeated task
leaves one whole copy.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, new_path

#: Samples in a row of the image; payloads are padded to a multiple of it.
WIDTH = 192
HEADER_BYTES = 33
#: A shard is closed beyond this many bytes.
SHARD_BYTES = 64 << 20
_SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes of the text padded with spaces to a positive multiple of WIDTH, and their count before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" "), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_image(media: bytes) -> bytes:
    width, height, _ = image_header(media)
    at, packed = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return np.ascontiguousarray(rows[:, 1:]).tobytes()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """A tar file that grows in the shared folder."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.at, self.members = 0, {}

    def put(self, payload: bytes) -> tuple[str, int, int]:
        """Digest, offset and length of the stored payload; equal payloads are stored once."""
        key = hashlib.sha256(payload).digest()
        if key not in self.members:
            media = encode_image(payload)
            digest = hashlib.sha256(media).hexdigest()
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(media)
            self.out.write(entry.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512))
            self.members[key] = (digest, self.at + 512, len(media))
            self.at += 512 + -(-len(media) // 512) * 512
        return self.members[key]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(self.temporary, self.path)


INDEX_DDL = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every text of ``docs`` (``doc_id``, ``text``) and return the index, one row per row.

    A null text is stored as the empty text, a null ``doc_id`` stays null, rows
    that repeat a text refer to one member per shard, other columns are not read.
    ``folder`` must be one that all executors share; the default lies in
    ``spark.checkpoint.dir``.
    """
    folder = folder or new_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, shard, rows = TaskContext.get().partitionId(), 0, None, []

        def ready() -> pa.RecordBatch:
            shard.close()
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard is None:
                    shard = Shard(f"{folder}/{part:06d}-{number:05d}.tar")
                payload, n_bytes = payload_of(text.as_py() or "")
                digest, offset, length = shard.put(payload)
                rows.append((doc_id, n_bytes, digest, shard.uri, offset, length))
                if shard.at >= shard_bytes:
                    yield ready()
                    shard, rows, number = None, [], number + 1
        if shard is not None:
            yield ready()

    return cut(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, INDEX_DDL), "media-index")


class Reader:
    """Range reads from shards; the last shard stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            fs, path = _filesystem(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file.read_at(length, offset)


def read_headers(members: DataFrame) -> DataFrame:
    """``members`` (``digest, shard, offset, length``) with width, height and bit depth, from header bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [image_header(reader.read(uri, at, HEADER_BYTES)) for uri, at in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist())]
            more = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "width", "height", "depth"])

    kept = members.select("digest", "shard", "offset", "length")
    return map_arrow(kept, run, "digest string, shard string, offset long, length long, width long, height long, depth long")


def feature_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean sample and the shares of 16 sample ranges in per mille."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    return f"{width}x{height};{samples.mean():.3f};" + ",".join(map(str, shares))


def read_payloads(members: DataFrame) -> DataFrame:
    """What the stored bytes say: sizes, digests and the feature of each member of :func:`read_headers`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                media = reader.read(row["shard"], row["offset"], row["length"])
                payload = decode_image(media)
                rows.append(
                    (row["digest"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, row["width"], row["height"]))
                )
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(members, run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row of ``docs`` with what was read back of its stored payload.

    Each distinct content is read once, from its first place in the shards.
    """
    index = store(docs, folder, shard_bytes)
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    members = index.groupBy("digest").agg(place).select("digest", "place.*")
    described = read_payloads(read_headers(members))
    return index.select("doc_id", "n_bytes", "digest").join(described, "digest")
