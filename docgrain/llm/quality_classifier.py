"""Quality by compression: dictionaries from good and bad labelled text, and a calibrated size difference.

A text that resembles good text compresses better with the dictionary trained on good text, and the
other way round. The difference of the two sizes, normalised by the text's length and by the size
without a dictionary, goes through a logistic curve fitted on labelled texts that neither dictionary
has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, worker_model
from .logistic import Curve, fit_curve
from .toxicity import labelled

#: Labelled rows of each class that a model is learned from at most, chosen by hash of the doc_id:
#: half of them for the dictionaries, half for the curve.
SAMPLE = {1: 6000, 0: 6000}
#: A dictionary's size; pieces of a text that go into its training, evenly spread over the whole text.
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES, PIECES = 1024, 4
LEVEL = 1
#: A text is compressed in consecutive chunks of this size, so that the dictionaries stay within reach to its end.
CHUNK_BYTES = 32 << 10


@dataclass
class Model:
    """Dictionaries (empty: none), and the curve over the size features or else one score for all."""

    good: bytes = b""
    bad: bytes = b""
    curve: Curve | None = None
    constant: float = 0.5


def pieces_of(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= PIECE_BYTES * PIECES:
        return [data] if data else []
    step = (len(data) - PIECE_BYTES) / (PIECES - 1)
    return [data[int(i * step) : int(i * step) + PIECE_BYTES] for i in range(PIECES)]


def train(pieces: list[bytes]) -> bytes:
    """A dictionary; of the raw pieces where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


class Sizer:
    """Compressed sizes of texts under both dictionaries and none, summed over a text's chunks."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = []
        for data in (good, bad, b""):
            if len(data) >= 8:
                own = zstandard.ZstdCompressionDict(data)
                own.precompute_compress(level=LEVEL)
                self.by.append(zstandard.ZstdCompressor(dict_data=own, **options))
            else:
                self.by.append(zstandard.ZstdCompressor(**options))

    def sizes(self, text: str | None) -> tuple[int, int, int, int]:
        data = (text or "").encode("utf-8", "surrogatepass")
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, max(1, len(data)), CHUNK_BYTES)]
        return (*(sum(len(c.compress(x)) for x in chunks) for c in self.by), len(data))


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised size difference, alone and against how compressible and how long the text is."""
    good, bad, none, n = np.asarray(sizes, float).reshape(-1, 4).T
    n = np.maximum(n, 1)
    difference, ratio = (bad - good) / n, (bad - good) / np.maximum(np.maximum(bad, good), 1)
    own, length = none / n, np.log1p(n)
    return np.c_[
        difference, ratio, own, good / n, length, difference * length, ratio * length,
        own * own, own * length, difference * own, np.minimum(difference, 0),
    ]


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2,
    most: dict[int, int] | None = None,
) -> Model:
    """A model from labelled documents outside the held-out fold (crc32 of doc_id mod ``modulus``).

    Learned from at most SAMPLE rows per class, of which the driver gets PIECES pieces of PIECE_BYTES
    for the dictionaries, and four sizes for the curve. Without labels of both classes every text
    scores the share of label 1 (a half if there are none).
    """
    rows = checkpointed(labelled(docs, labels, label, modulus, held_out, most or SAMPLE))
    half = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(p, y) for t, y in zip(batch.column(0), batch.column(1).to_pylist()) for p in pieces_of(t.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], ["piece", "y"]
            )

    pieces = rows.where(half == 0).orderBy("doc_id", "text").select("text", "y").mapInArrow(cut, "piece binary, y int")
    by: dict[int, list[bytes]] = {0: [], 1: []}
    for r in pieces.toLocalIterator():
        by[r[1]].append(bytes(r[0]))
    model = Model(train(by[1]) if by[1] else b"", train(by[0]) if by[0] else b"")
    measured = rows.where(half == 1).select("y", sizes(model)(F.col("text")).alias("s")).collect()
    y = np.array([r[0] for r in measured], float)
    if len(y):
        model.curve, model.constant = fit_curve(features(np.array([list(r[1]) for r in measured])), y), float(y.mean())
    return model


def _sizer(good: bytes, bad: bytes) -> Sizer:
    return worker_model(("quality", good, bad), lambda: Sizer(good, bad))


def sizes(model: Model):
    """Column function: text to its compressed sizes (good, bad, no dictionary) and its length."""
    good, bad = model.good, model.bad

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizer = _sizer(good, bad)
        for texts in batches:
            yield pa.array([sizer.sizes(t.as_py()) for t in texts], pa.list_(pa.int64()))

    return run


def quality(model: Model):
    """Column function: text to score. A null text scores as an empty one."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizer = _sizer(model.good, model.bad)
        for texts in batches:
            if not len(texts):
                yield pa.array([], pa.float64())
                continue
            if model.curve is None:
                yield pa.array(np.full(len(texts), model.constant))
            else:
                yield pa.array(model.curve(features(np.array([sizer.sizes(t.as_py()) for t in texts]))))

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts share one score; long texts are compressed to their end, in chunks; repeated
    rows and null doc_ids stay; other columns are ignored; an empty table gives an empty one.
    """
    scored = docs.select("doc_id", quality(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_poor(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose texts score the threshold or more, all columns as they were."""
    scored = docs.withColumn("__quality", quality(model)(F.col("text")))
    return scored.where(F.col("__quality") >= threshold).select(*docs.columns)
