"""Near-duplicates by SimHash fingerprints, linked through pivot distance tables.

Fingerprints are made in one Arrow pass and copies collapse to distinct fingerprints. Each of these
gets a row of a distance table: its Hamming distances to fixed reference fingerprints (pivots). By
the triangle inequality two fingerprints within distance d differ by at most d in every coordinate.
Each pivot differs from a base pivot within one block of bits, so a pair that is equal in a block is
equal in the block's coordinates relative to the base; a pair within 2 bits is equal in two of four
blocks at least. Pairs are therefore sought among fingerprints that agree in the coordinates of two
blocks, discarded by their largest coordinate difference, and only survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, named_rows, small_or_not
from .graph import components, first_of_each

SHINGLE = 3
SEED = 42
MOST = 2
BLOCKS = 4
#: Pivots per block besides the base.
PIVOTS = 10
#: Fingerprints in a bucket that are compared in one place. It bounds a task's memory. A bucket is one of
#: 2 ** 32, so only those of dense clusters are fuller; `dense_links` is the exact way for these.
FULL = 1024
#: Pairs whose coordinates are compared at a time.
PAIRS = 1 << 16


def pivots(seed: int = 20240607) -> list[tuple[int, int]]:
    """(block, pivot): the base pivot (block -1) and those that flip about half of a block's bits."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 63)) << 1 | 1
    out = [(-1, base)]
    width = 64 // BLOCKS
    for b in range(BLOCKS):
        for _ in range(PIVOTS):
            flips = rng.permutation(width)[: width // 2]
            out.append((b, base ^ sum(1 << (b * width + int(i)) for i in flips)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text; zero where it has no word (or is null)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), "<u8", n), n)


def majority(hashes: np.ndarray, n: int) -> int:
    """The number whose bits are those set in over half of ``n`` hashes; zero for none."""
    one = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        one += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * one > n, bitorder="little").view("<u8")[0])


def fingerprint(shingle: int = SHINGLE, seed: int = SEED):
    """Column function: text to fingerprint, as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = np.fromiter((fingerprint_of(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.array(got.view(np.int64))

    return run


def distance_table(fingerprints: DataFrame) -> DataFrame:
    """Distinct fingerprints (``f``) with ``coordinates``: their distances to all pivots."""
    distance = [F.bit_count(F.col("f").bitwiseXOR(F.lit(_signed(p)))).cast("byte") for _, p in pivots()]
    return fingerprints.select("f", F.array(*distance).alias("coordinates"))


def _keys(table: DataFrame) -> DataFrame:
    """``table`` with ``keys``: a hash of the coordinates of each pair of blocks, relative to the base."""
    first = {b: 1 + b * PIVOTS for b in range(BLOCKS)}
    c = F.col("coordinates")
    block = {b: [c[first[b] + i] - c[0] for i in range(PIVOTS)] for b in range(BLOCKS)}
    pairs = [F.xxhash64(F.lit(i), *block[a], *block[b]) for i, (a, b) in enumerate(combinations(range(BLOCKS), 2))]
    return table.select("f", "coordinates", F.array(*pairs).alias("keys"))


def _near(own: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket that their coordinates don't discard and that really are within ``most`` bits."""
    step = max(1, PAIRS // max(1, len(own)))
    for at in range(0, len(own), step):
        difference = np.abs(rows[at : at + step, None] - rows[None, at:]).max(axis=2)
        i, j = np.nonzero(difference <= most)
        i, j = i[j > i] + at, j[j > i] + at
        real = np.bitwise_count(own[i] ^ own[j]) <= most
        yield from zip(i[real].tolist(), j[real].tolist())


def _bucket_links(most: int):
    """Arrow function: buckets of (f, coordinates) to verified links, as a forest per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            ends = np.asarray(members.offsets)
            flat = members.values
            f = flat.field(0).to_numpy()
            table = np.asarray(flat.field(1).values).reshape(len(f), -1).astype(np.int8) if len(f) else None
            left, right = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                own, rows = f[a:b], table[a:b]
                root = list(range(b - a))
                for x, y in _near(own.view(np.uint64), rows, most):
                    while root[x] != x:
                        x = root[x]
                    while root[y] != y:
                        y = root[y]
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        left.append(own[x])
                        right.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def dense_links(fingerprints: DataFrame, most: int = MOST) -> DataFrame:
    """Links that join exactly the fingerprints (``f``) within distance ``most`` of each other, without pairs.

    Each fingerprint meets, at itself and at each fingerprint one bit away, those that have the place
    within one bit as well: two fingerprints meet somewhere if and only if they are within two bits.
    At most 65 meet at a place, so a place gives one link per fingerprint, to the least that it holds
    (for a distance of one: to the place itself, if that is a fingerprint).
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    near = fingerprints.select("f", F.explode(F.transform(flips, lambda m: F.col("f").bitwiseXOR(m))).alias("place"))
    met = near.groupBy("place").agg(F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    hub = F.array_min("fs")
    if most < 2:
        met, hub = met.where(F.array_contains("fs", F.col("place")) & F.lit(most == 1)), F.col("place")
    return met.select(F.explode("fs").alias("a"), hub.alias("b")).where("a <> b").distinct()


def links(fingerprints: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``f``) that connect exactly those within
    ``most`` (2 at most) differing bits, directly or over others.

    Buckets of up to FULL members are compared through the distance table, in one place each. The
    members of fuller ones are linked by :func:`dense_links`, which is exact whatever their number.
    """
    if not 0 <= most <= 2:
        raise ValueError("two of four blocks must stay equal: most is 0, 1 or 2")
    table = checkpointed(_keys(distance_table(fingerprints)))
    keys = table.select("f", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = checkpointed(sizes)
    full = small_or_not(sizes.where(F.col("size") > FULL).select("key"))
    dense = keys.join(full, "key", "left_semi").select("f").distinct()
    some = sizes.where(F.col("size") <= FULL).select("key")
    keyed = table.select("f", "coordinates", F.explode("keys").alias("key")).join(some, "key", "left_semi")
    buckets = keyed.groupBy("key").agg(F.collect_list(F.struct("f", "coordinates")).alias("members")).select("members")
    found = buckets.mapInArrow(_bucket_links(most), "a long, b long").distinct()
    return found.unionByName(dense_links(dense, most))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, root.

    component_id is the smallest doc_id that links reach, the document's own included; root names the
    component by its least fingerprint (signed). Texts of any length are taken whole, ties included;
    an empty table gives an empty one. Texts without a word, null texts among them, have
    fingerprint zero and are linked like any other. Null doc_ids never are the smallest; a component
    of these alone has a null id. Repeated rows stay. Other columns are ignored.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(shingle, seed)(F.col("text")).alias("f"))
    made = checkpointed(made)
    firsts = made.groupBy("f").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = checkpointed(firsts)
    rooted = checkpointed(components(links(firsts.select("f"), most)))
    named = firsts.join(rooted, F.col("f") == F.col("node"), "left").select(
        "f", "first", "rows", F.coalesce("root", "f").alias("root")
    )
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("r"), "inner").select("f", "rows", "root", "component_id")
    out = named_rows(made, named, "f", "rows")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Rows are kept as they are. Of rows that repeat the kept doc_id with another text of the group, the
    one of the least fingerprint stays; of a group without any doc_id likewise. No group is lost.
    """
    own = F.lower(F.lpad(F.hex(fingerprint(shingle, seed)(F.col("text"))), 16, "0"))
    return first_of_each(docs, near_duplicates(docs, shingle, seed, most), "fingerprint", own)
