"""Token ids in files of length-delimited binary records, with a separate offset index.

A record is framed as: data length (unsigned 64-bit), masked CRC-32 of these eight bytes, the data,
masked CRC-32 of the data; all little-endian. Masking (rotation by 15 bits and a constant) keeps
checksums apart from data that hold checksums. The data of a token record are the document's id
(signed 64-bit), a byte for the width of a token (2 or 4) and the token ids. The index beside each
file has one fixed-width entry per record, so a shuffled read seeks straight to any record.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .storage import Store
from .tokens import encoder

END_ID = 2
_HEAD, _CRC, _DOC = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
#: Index entry: offset and length of the frame, tokens of the file before the record, tokens of the record.
_ENTRY = struct.Struct("<QQQQ")
_NO_ID = 1  # flag of a record whose document has no id
#: A file is closed at this size.
FILE_BYTES = 256 << 20
MANIFEST = "file string, ordinal long, part int, n_records long, n_tokens long, n_bytes long"


def entry(offset: int, length: int, before: int, tokens: int) -> bytes:
    return _ENTRY.pack(offset, length, before, tokens)


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = _HEAD.pack(len(data))
    return b"".join((head, _CRC.pack(masked(zlib.crc32(head))), data, _CRC.pack(masked(zlib.crc32(data)))))


def unframe(file) -> bytes | None:
    """The data of the record at the file's place; None at its end. Raises ValueError if damaged."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != _CRC.unpack_from(head, 8)[0]:
        raise ValueError("damaged record length")
    (n,) = _HEAD.unpack_from(head)
    body = file.read(n + 4)
    if len(body) < n + 4 or masked(zlib.crc32(body[:n])) != _CRC.unpack_from(body, n)[0]:
        raise ValueError("damaged record data")
    return body[:n]


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None
) -> DataFrame:
    """Encodes ``docs`` into record files in ``folder`` (shared storage), in ascending doc_id order
    over the files in order of (ordinal, part); returns the manifest of files.

    Null texts count as empty: the end id alone. Null ids come first; rows of one id stand in order
    of their texts. An empty table writes no file. A file appears whole, under a name of its own
    for each attempt, and only files of the manifest (checkpointed) are ever read, so retried and
    lost tasks do no harm.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, enc = Store(folder), encoder(tokenizer)
        ordinal = TaskContext.get().partitionId()
        wide = enc.tok.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        width = 4 if wide else 2
        out = index = None
        done: list[tuple] = []

        def close() -> None:
            index.close()
            out.close()
            done.append((out.name, ordinal, len(done), records, tokens, out.at))

        for batch in batches:
            keys = batch.column(0)
            for first, counts, rows in enc.blocks(batch.column(1), True):
                for i, ids in enumerate(rows):
                    if out is not None and out.at >= FILE_BYTES:
                        close()
                        out = None
                    if out is None:
                        name = f"tokens-{ordinal:06d}-{len(done):04d}-{uuid.uuid4().hex}.rec"
                        out, index = store.create(name), store.create(name + ".idx")
                        records = tokens = 0
                    record = token_record(keys[first + i].as_py(), np.append(ids, np.uint32(end_id)), width)
                    index.write(entry(out.write(record), len(record), tokens, len(ids) + 1))
                    records += 1
                    tokens += len(ids) + 1
        if out is not None:
            close()
        cols = list(zip(*done)) if done else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            ["file", "ordinal", "part", "n_records", "n_tokens", "n_bytes"],
        )

    return checkpointed(ordered.mapInArrow(run, MANIFEST))


def token_record(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """A framed token record; a document without an id is flagged."""
    head = _DOC.pack(doc_id or 0, width, _NO_ID if doc_id is None else 0)
    return frame(head + ids.astype("<u4" if width == 4 else "<u2").tobytes())


def read_index(folder: str, file: str) -> np.ndarray:
    """Entries of a file's index: an array of (offset, length, tokens before, tokens)."""
    with Store(folder).reader(file + ".idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 4)


def read_record(file, offset: int) -> tuple[int | None, np.ndarray]:
    """The document id and token ids of the record at ``offset`` of an open file."""
    file.seek(offset)
    data = unframe(file)
    key, width, flags = _DOC.unpack_from(data)
    return None if flags & _NO_ID else key, np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=_DOC.size)


def read_records(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The records of all files: doc_id, start (tokens of all records before), n_tokens, ids_crc32 (of
    the ids as little-endian unsigned 32-bit numbers), and the ids if asked for. Checksums are verified.

    The running start over files is a window over the manifest, one row per file of FILE_BYTES.
    """
    before = Window.orderBy("ordinal", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = read_index(folder, name)
                with store.reader(name) as f:
                    for a in range(0, len(index), 2000):
                        part = index[a : a + 2000]
                        keys, crcs, rows = [], [], []
                        for at, _, _, n in part.tolist():
                            key, ids = read_record(f, at)
                            if len(ids) != n:
                                raise ValueError("index and record differ")
                            keys.append(key)
                            crcs.append(zlib.crc32(ids.astype("<u4").data))
                            if with_ids:
                                rows.append(ids.astype("i8"))
                        out = [pa.array(keys, pa.int64()), pa.array(part[:, 2].astype("i8") + base)]
                        out += [pa.array(part[:, 3].astype("i8")), pa.array(crcs, pa.int64())]
                        if with_ids:
                            out.append(pa.array(rows, pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(
                            out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)]
                        )

    return files.select("file", F.col("base").cast("long")).mapInArrow(run, fields)
