"""Blocks to size-bounded parts that begin at sections where they can.

Works on the array of blocks in a document's row. Blocks that touch, or follow a heading, form a
group that is never split; groups are packed greedily in order. The packing is a left fold with
restarts: it runs in one Arrow function over four numbers per block, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_heading
from .blocks import render

#: Bytes between two groups of a part, as the size bound counts them.
SEPARATOR = 2


def groups_of(kinds: list[str], levels: list[int], gaps: list[int], sizes: list[int]) -> list[tuple]:
    """(first block, end, bytes, starts with a heading?, level, of one code or html block?) per group."""
    out: list[list] = []
    for i, (kind, level, size) in enumerate(zip(kinds, levels, sizes)):
        if out and (gaps[i - 1] == 0 or kinds[i - 1] == "heading"):
            g = out[-1]
            g[1], g[2], g[5] = i + 1, g[2] + gaps[i - 1] + 1 + size, False
        else:
            out.append([i, i + 1, size, kind == "heading", level, kind in ("code", "html")])
    return [tuple(g) for g in out]


def fill(groups: list[tuple], size: int) -> list[tuple[int, int]]:
    """Runs of groups, one per part, of at most ``size`` bytes as far as groups allow.

    A part ends before a heading once it is filled enough for that level, or where the next group
    would overflow it; an overflow that isn't at a heading goes back to the last heading passed, if
    at least a quarter lies before that.
    """
    runs: list[tuple[int, int]] = []
    first = 0
    while first < len(groups):
        total, retreat = groups[first][2], None
        end = first + 1
        while end < len(groups):
            _, _, own, heading, level, _ = groups[end]
            enough = size // 4 if level <= 2 else size // 2
            if heading and total >= enough:
                break
            if total + SEPARATOR + own > size:
                if not heading and retreat is not None:
                    end = retreat
                break
            if heading:
                retreat = end if total >= size // 4 else None
            total += SEPARATOR + own
            end += 1
        runs.append((first, end))
        first = end
    return runs


def _pieces_udf(work, kind: pa.DataType, ddl: str):
    """Arrow function over blocks: ``work(kinds, levels, gaps, sizes)`` per document."""

    @F.arrow_udf(ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends, flat = batch.offsets.to_pylist(), batch.values
            fields = [flat.field(i).to_pylist() for i in range(4)]
            yield pa.array([work(*(f[a:b] for f in fields)) for a, b in zip(ends[:-1], ends[1:])], kind)

    return run


def _slim(blocks: Column) -> Column:
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["kind"].alias("kind"), b["level"].alias("level"), b["gap"].alias("gap"), b["n_bytes"].alias("n_bytes")
        ),
    )


def with_groups(parsed: DataFrame, blocks: str = "blocks", out: str = "groups") -> DataFrame:
    """``parsed`` with ``out``: array of (block_from, block_to exclusive, size, heading, level, atomic)."""
    fields = [("block_from", pa.int32()), ("block_to", pa.int32()), ("size", pa.int32()), ("heading", pa.bool_()),
              ("level", pa.int32()), ("atomic", pa.bool_())]
    names = [f for f, _ in fields]
    ddl = "array<struct<block_from: int, block_to: int, size: int, heading: boolean, level: int, atomic: boolean>>"
    work = lambda k, v, g, s: [dict(zip(names, x)) for x in groups_of(k, v, g, s)]
    return parsed.withColumn(out, _pieces_udf(work, pa.list_(pa.struct(fields)), ddl)(_slim(F.col(blocks))))


def group_rows(parsed: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """The groups as rows, from windows over block rows: gaps and islands, for use on stored blocks."""
    from pyspark.sql import Window

    from .blocks import block_rows

    rows = block_rows(parsed, keys, blocks).drop("text")
    w = Window.partitionBy(*keys).orderBy("block_idx")
    before = F.lag("gap").over(w)
    new = before.isNotNull() & (before != 0) & (F.lag("kind").over(w) != "heading")
    rows = rows.withColumn("new", F.coalesce(new, F.lit(False)).cast("int"))
    rows = rows.withColumn("group_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    first = lambda c: F.min_by(c, "block_idx")
    return rows.groupBy(*keys, "group_idx").agg(
        F.min("block_idx").alias("block_from"),
        (F.max("block_idx") + 1).alias("block_to"),
        (F.sum(F.col("n_bytes") + F.col("gap") + 1) - F.max_by(F.col("gap") + 1, "block_idx")).cast("int").alias("size"),
        first(F.col("kind") == "heading").alias("heading"),
        first("level").alias("level"),
        ((F.count(F.lit(1)) == 1) & first(F.col("kind").isin("code", "html"))).alias("atomic"),
    )


def with_parts(parsed: DataFrame, size: int, blocks: str = "blocks", out: str = "parts") -> DataFrame:
    """``parsed`` with ``out``: the document's parts, an array of (block_from, block_to, gap_after, n_groups).

    size: bytes, at least 1. gap_after is the number of blank lines to the next part, null for the last.
    """
    size = max(1, size)
    fields = [("block_from", pa.int32()), ("block_to", pa.int32()), ("gap_after", pa.int32()), ("n_groups", pa.int32())]

    def work(kinds, levels, gaps, sizes):
        groups = groups_of(kinds, levels, gaps, sizes)
        return [
            {"block_from": groups[a][0], "block_to": groups[b - 1][1], "n_groups": b - a,
             "gap_after": gaps[groups[b - 1][1] - 1] if b < len(groups) else None}
            for a, b in fill(groups, size)
        ]

    ddl = "array<struct<block_from: int, block_to: int, gap_after: int, n_groups: int>>"
    return parsed.withColumn(out, _pieces_udf(work, pa.list_(pa.struct(fields)), ddl)(_slim(F.col(blocks))))


def part_rows(packed: DataFrame, keys: list[str], size: int, blocks: str = "blocks", parts: str = "parts") -> DataFrame:
    """One row per part: keys, part (from 1), n_parts, text, n_bytes, gap_after, heading, oversize."""
    rows = packed.select(*keys, F.col(blocks), F.size(parts).alias("n_parts"), F.posexplode(parts).alias("part", "p"))
    own = F.slice(F.col(blocks), F.col("p.block_from") + 1, F.col("p.block_to") - F.col("p.block_from"))
    rows = rows.select(
        *keys, (F.col("part") + 1).alias("part"), "n_parts", own.alias("own"), F.col("p.gap_after").alias("gap_after")
    )
    rows = rows.select(*keys, "part", "n_parts", render(F.col("own")).alias("text"), "gap_after")
    return rows.select(
        *keys, "part", "n_parts", "text", F.octet_length("text").alias("n_bytes"), "gap_after",
        first_heading(F.col("text")).alias("heading"), (F.octet_length("text") > max(1, size)).alias("oversize"),
    )


def texts_of(blocks: str = "blocks", parts: str = "parts") -> Column:
    """The parts of a row of :func:`with_parts` as an array of (text, gap), ``gap`` being the blank lines before."""
    own = lambda p: F.slice(F.col(blocks), p["block_from"] + 1, p["block_to"] - p["block_from"])
    return F.transform(
        parts,
        lambda p, i: F.struct(render(own(p)).alias("text"), F.get(F.col(parts), i - 1)["gap_after"].alias("gap")),
    )


def split(docs: DataFrame, size: int = 8000, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents to parts; see :func:`part_rows`. No shuffle: every step stays in the document's row."""
    from .blocks import with_blocks

    keys = keys or ["doc_id"]
    parsed = with_blocks(docs.select(*keys, text), text).select(*keys, "blocks")
    return part_rows(with_parts(parsed, size), keys, size)
