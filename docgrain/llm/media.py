"""Media columns: content-addressed payloads in tar shards, found again by digest, offset and length.

A payload is kept as an 8-bit grey image (PNG: lossless, and compressed as its rows allow), a tar
member named by the payload's SHA-256. A digest has one place that all its rows point to. Rows carry the shard,
the digest, and the offset and length of the stored bytes, so a reader seeks straight to them; the
header columns need the first bytes of a payload only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_or_not
from .storage import Store

#: Pixels of an image row; a payload is whole rows.
WIDTH = 192
_SIGN = b"\x89PNG\r\n\x1a\n"
#: Signature and the whole first chunk: all that the header columns take.
HEADER_BYTES = 33
LEVEL = 6
SHARD_BYTES = 256 << 20
#: Shards that a reading task keeps open.
OPEN = 8
INDEX = "doc_id long, n_bytes long, shard string, digest string, offset long, length long"


def payload_of(text: str | None, width: int = WIDTH) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, filled with spaces to a positive multiple of ``width``, and their number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // width)) * width
    return data.ljust(size, b" "), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as a PNG of 8-bit grey samples, ``width`` to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits per sample) from the first HEADER_BYTES of an image."""
    if data[:8] != _SIGN or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack_from(">I", data, 29)[0]:
        raise ValueError("not an image header")
    width, height, bits = struct.unpack_from(">IIB", data, 16)
    return width, height, bits


def decode_image(data: bytes) -> bytes:
    """The samples of an image of :func:`encode_image`, its checksums verified."""
    width, height, _ = decode_header(data)
    (n,) = struct.unpack_from(">I", data, HEADER_BYTES)
    body = data[HEADER_BYTES + 4 : HEADER_BYTES + 8 + n]
    if zlib.crc32(body) != struct.unpack_from(">I", data, HEADER_BYTES + 8 + n)[0]:
        raise ValueError("damaged image data")
    return np.frombuffer(zlib.decompress(body[4:]), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block for a plain file; times and owners are zero, so equal content is equal bytes."""
    block = bytearray(512)
    block[0 : len(name)] = name.encode()
    for at, text in ((100, "0000644"), (108, "0000000"), (116, "0000000"), (124, f"{size:011o}"), (136, "0" * 11)):
        block[at : at + len(text)] = text.encode()
    block[148:156] = b" " * 8
    block[156:157] = b"0"
    block[257:265] = b"ustar\x0000"
    block[148:156] = f"{sum(block):06o}\x00 ".encode()
    return bytes(block)


def store_payloads(docs: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """Writes the texts of ``docs`` to tar shards in ``folder`` (shared storage); returns the index.

    One index row per row of ``docs`` (see INDEX). Null texts count as empty: one row of spaces.
    Equal texts have equal digests and one place: tasks that met the same payload each wrote it (once a
    shard), and the first place by name serves all. Long texts are stored whole; null doc_ids stay null; an
    empty table writes no shard and gives an empty index. A shard gets its name by
    rename when it is whole, each attempt under a name of its own, and the index is checkpointed:
    rows never point to a shard of a failed attempt. Names of other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        tar, known, waiting = None, {}, []

        def close() -> pa.RecordBatch:
            tar.write(bytes(1024))
            tar.close()
            cols = list(zip(*waiting))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        names = ["doc_id", "n_bytes", "shard", "digest", "offset", "length"]
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                payload, size = payload_of(text.as_py(), width)
                digest = hashlib.sha256(payload).hexdigest()
                if tar is None:
                    tar, known, waiting = store.create(f"media-{uuid.uuid4().hex}.tar"), {}, []
                if digest not in known:
                    data = encode_image(payload, width)
                    tar.write(tar_header(f"{digest}.png", len(data)))
                    known[digest] = (tar.write(data), len(data))
                    tar.write(bytes(-len(data) % 512))
                waiting.append((key.as_py(), size, tar.name, digest, *known[digest]))
                if tar.at >= SHARD_BYTES or len(waiting) >= 200_000:
                    yield close()
                    tar = None
        if tar is not None:
            yield close()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = checkpointed(narrow.mapInArrow(run, INDEX))
    place = F.struct("shard", "offset", "length")
    places = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    moved = small_or_not(places.where("first <> last").select(F.col("digest").alias("d"), "first"))
    # Only rows whose digest has several places look one up; all others stay where they are, in order of their shard.
    index = found.join(moved, F.col("digest") == F.col("d"), "left")
    at = [F.coalesce(F.col(f"first.{c}"), F.col(c)).alias(c) for c in ("shard", "offset", "length")]
    return checkpointed(index.select("doc_id", "n_bytes", at[0], "digest", *at[1:]))


def _read(
    index: DataFrame, folder: str, fields: str, kinds: list, size: int | None, made: Callable, remember: int = 50_000
) -> DataFrame:
    """``index`` with columns that ``made(stored bytes, digest)`` gives.

    size: bytes to read of each payload; None for all. A task remembers what the last ``remember`` places gave.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields), fields])
    names = [*index.columns, *(x.split()[0] for x in fields.split(", "))]
    where = [index.columns.index(c) for c in ("shard", "digest", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        files: OrderedDict = OrderedDict()  # the last few shards, open
        recent: OrderedDict = OrderedDict()  # results by place: copies in a row of rows cost one read
        for batch in batches:
            rows = []
            for shard, digest, offset, length in zip(*(batch.column(i).to_pylist() for i in where)):
                place = (shard, offset)
                if place not in recent:
                    if shard not in files:
                        files[shard] = store.reader(shard)
                        if len(files) > OPEN:
                            files.popitem(last=False)[1].close()
                    files.move_to_end(shard)
                    file = files[shard]
                    file.seek(offset)
                    recent[place] = made(file.read(length if size is None else min(size, length)), digest)
                    if len(recent) > remember:
                        recent.popitem(last=False)
                rows.append(recent[place])
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names
            )
        for file in files.values():
            file.close()

    return index.mapInArrow(run, schema)


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with width, height and bits, from range reads of HEADER_BYTES per payload."""
    kinds = [pa.int32(), pa.int32(), pa.int32()]
    return _read(index, folder, "width int, height int, bits int", kinds, HEADER_BYTES, lambda d, _: decode_header(d))


def features(payload: bytes, width: int, height: int) -> str:
    """What the samples look like: shape, mean and variance in hundredths, distinct samples, mean step
    between neighbours in hundredths, share of blanks in ten-thousandths. Integers only."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    step = int(np.abs(np.diff(x.astype(np.int16))).sum())
    return (
        f"w={width};h={height};mean={100 * total // n};var={100 * (n * square - total * total) // (n * n)};"
        f"distinct={int((np.bincount(x, minlength=256) > 0).sum())};step={100 * step // max(1, n - 1)};"
        f"blank={10000 * int((x == 32).sum()) // n}"
    )


def read_payloads(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """``index`` with what the stored bytes show when read back: payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, and the payload itself if asked for.

    Raises ValueError where stored bytes don't match their digest.
    """

    def made(data: bytes, digest: str) -> tuple:
        width, height, _ = decode_header(data)
        payload = decode_image(data)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest:
            raise ValueError("stored bytes and digest differ")
        tail, stored = zlib.crc32(payload[-16:]), hashlib.sha256(data).hexdigest()
        row = (len(payload), sha, tail, len(data), stored, features(payload, width, height))
        return (*row, payload) if with_payload else row

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if with_payload:
        fields, kinds = fields + ", payload binary", [*kinds, pa.binary()]
    return _read(index, folder, fields, kinds, None, made, 1 if with_payload else 50_000)
