"""Media columns: archives of many small media files as a data source.

An archive is its members' bytes end to end, then a directory with one fixed-width entry for each member, then a
trailer that says where the directory begins. The reader plans byte ranges over the archives from their sizes
alone; a task reads its archive's directory, takes the members that begin in its range, reads each by its own
offset, tries a member again by itself when reading or its checksum fails, and hands payloads on as Arrow batches of bounded size.

Each write adds a manifest that names its archives; archives that no manifest names don't exist for readers. A write that replaces what is there names the manifests that it
takes the place of, so one file makes it visible as a whole; then it deletes what it has replaced.

A payload is stored as the 8-bit samples of a PNG image 64 pixels wide: 192 bytes are one row of red, green and blue.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tandem.llm.storage import new_folder, require, text_or_empty

ROW_BYTES = 192
WIDTH = ROW_BYTES // 3
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("crc32", "<u4"), ("has_id", "u1"), ("doc_id", "<i8"), ("n_bytes", "<i8")])
TRAILER = struct.Struct("<QQ8s")
MAGIC = b"members1"
MANIFEST = "manifest-"
SCHEMA = "doc_id long, n_bytes long, media binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
ATTEMPTS = 4


# --- images ---


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of a row."""
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit RGB image whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    filtered = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    at, body, height = 8, [], 0
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height, depth, color = struct.unpack_from(">IIBB", media, at + 8)
            if (width, depth, color) != (WIDTH, 8, 2):
                raise ValueError("not an image of this kind")
        elif kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, ROW_BYTES + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def image_feature(payload: bytes) -> str:
    """Height, mean of each color and a 64-bit average hash of an 8 x 8 sample."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    light = image.sum(axis=2, dtype=np.int64)
    small = light[(np.arange(8) * len(light)) // 8][:, (np.arange(8) * WIDTH) // 8]
    bits = np.packbits(small * 64 > small.sum()).tobytes().hex()
    means = (image.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (len(light) * WIDTH)).tolist()
    return f"{WIDTH}x{len(light)} {'/'.join(map(str, means))} {bits}"


# --- archives ---


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Archives(WriterCommitMessage):
    made: list[tuple[str, int]]  # names and bytes of members


class ArchiveWriter(DataSourceArrowWriter):
    """A task writes archives of its own, under names that begin with the write's and that no other attempt uses; the driver names those of tasks that succeeded, and deletes the others."""

    def __init__(self, options: dict[str, str], overwrite: bool = False) -> None:
        self.path = options["path"]
        self.most = int(options.get("archive_bytes", 128 << 20))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        made, out, entries, at, name = [], None, [], 0, ""

        def close() -> None:
            directory = np.array(entries, ENTRY)
            out.write(directory.tobytes())
            out.write(TRAILER.pack(at, len(directory), MAGIC))
            out.close()
            made.append((name, at))

        for batch in iterator:
            for doc_id, n_bytes, media in zip(*(batch[c].to_pylist() for c in ARROW.names), strict=True):
                if out is None:
                    name, entries, at = f"{self.job}-{uuid.uuid4().hex}.archive", [], 0
                    out = system.open_output_stream(f"{folder}/{name}")
                out.write(media)
                entries.append((at, len(media), zlib.crc32(media), doc_id is not None, doc_id or 0, n_bytes))
                at += len(media)
                if at >= self.most:
                    close()
                    out = None
        if out is not None:
            close()
        return Archives(made)

    def commit(self, messages: list[Archives | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        made = [x for m in messages if m for x in m.made]
        replaced = _manifests(system, folder) if self.overwrite else {}
        with system.open_output_stream(f"{folder}/{MANIFEST}{self.job}.json") as f:
            f.write(json.dumps({"archives": made, "replaces": list(replaced)}).encode())
        for name, found in replaced.items():
            for archive, _ in found:
                _delete(system, f"{folder}/{archive}")
            _delete(system, f"{folder}/{name}")
        self._clean({name for name, _ in made})

    def abort(self, messages: list[Archives | None]) -> None:
        self._clean(set())

    def _clean(self, stay: set[str]) -> None:
        """Deletes this write's archives but those to stay: what attempts left that failed or came second."""
        system, folder = _open(self.path)
        for info in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"{self.job}-") and info.base_name not in stay:
                _delete(system, info.path)


def _delete(system: pafs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type != pafs.FileType.NotFound:
        system.delete_file(path)


def _manifests(system: pafs.FileSystem, folder: str) -> dict[str, list[tuple[str, int]]]:
    """The archives, as names and bytes of members, of each manifest in force."""
    found = {}
    for info in system.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.startswith(MANIFEST):
            with system.open_input_file(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return {name: m["archives"] for name, m in sorted(found.items()) if name not in gone}


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__((self.name, self.start, self.stop))


class MemberError(OSError):
    """A member could not be read whole."""


def read_member(system: pafs.FileSystem, path: str, offset: int, length: int, crc32: int, attempts: int = ATTEMPTS, wait_s: float = 0.2) -> bytes:
    """The bytes of one member. Each attempt opens the archive anew, so one bad read doesn't touch other members."""
    for k in range(attempts):
        try:
            with system.open_input_file(path) as f:
                data = f.read_at(length, offset)
            if len(data) == length and zlib.crc32(data) == crc32:
                return data
            problem: Exception = MemberError(f"{path}: member at {offset} is damaged")
        except OSError as e:
            problem = e
        time.sleep(wait_s * 2**k * (k < attempts - 1))
    raise MemberError(f"{path}: member at {offset}, {length} bytes, failed {attempts} times") from problem


def read_directory(system: pafs.FileSystem, path: str) -> np.ndarray:
    with system.open_input_file(path) as f:
        size = f.size()
        at, n, magic = TRAILER.unpack(f.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or at + n * ENTRY.itemsize + TRAILER.size != size:
            raise ValueError(f"{path} is no archive or is cut off")
        return np.frombuffer(f.read_at(n * ENTRY.itemsize, at), ENTRY)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.range = int(options.get("range_bytes", 16 << 20))
        self.batch = int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        system, folder = _open(self.path)
        archives = [x for m in _manifests(system, folder).values() for x in m]
        found = [ByteRange(name, at, min(size, at + self.range)) for name, size in archives for at in range(0, size, self.range)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, folder = _open(self.path)
        path = f"{folder}/{partition.name}"
        directory = read_directory(system, path)
        first, last = np.searchsorted(directory["offset"], [partition.start, partition.stop])
        rows, held = [], 0
        for e in directory[first:last]:
            media = read_member(system, path, int(e["offset"]), int(e["length"]), int(e["crc32"]))
            rows.append((int(e["doc_id"]) if e["has_id"] else None, int(e["n_bytes"]), media))
            held += len(media)
            if held >= self.batch:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class MediaArchive(DataSource):
    """format("media_archive"): option path, a folder of archives; archive_bytes, range_bytes and batch_bytes bound sizes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:  # noqa: ANN001
        return ArchiveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


# --- documents as media ---


def store_texts(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Every text of docs as a member of archives at path, beside what is there or ("overwrite") in its place.

    Null counts as empty, and an empty text gives a row of spaces; rows without doc_id and repeated rows are stored like others; an empty table adds nothing. Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    register(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"].to_pylist()]
            media = [to_png(pad(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows.mapInArrow(encode, SCHEMA).write.format("media_archive").mode(mode).option("path", path).save()


def media_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (null where it was), n_bytes and media of every member of the archives at path, in byte ranges; repeated rows as often as they were stored, none of an empty store."""
    register(spark)
    return spark.read.format("media_archive").option("path", path).load()


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of decoded media: see text_media(). media: doc_id, n_bytes and media, not null, as media_rows() gives them; other columns are ignored, repeated rows stay."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
            for one in batch["media"]:
                stored = one.as_py()
                payload = from_png(stored)
                for name, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(payload)), strict=True):
                    out[name].append(value)
            arrays = [pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *arrays], ["doc_id", "n_bytes", *out])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text of docs as an image in archives in the shared folder, reads them back and describes them.

    Returns doc_id, n_bytes (of the text in UTF-8), payload_bytes, payload_sha256 and tail_crc32 (of the padded text as read
    back), media_bytes and media_sha256 (of the stored image), and feature. Null and empty texts are one row of spaces;
    repeated rows are stored and come back as often as they occur; an empty table gives none. Other columns are ignored.
    """
    path = new_folder(docs.sparkSession, "media")
    store_texts(docs, path)
    return media_features(media_rows(docs.sparkSession, path))
