"""Outlines, and sections found by address."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading_title, trim
from .blocks import render

SEPARATOR = " > "


TOPIC = [("block_idx", pa.int32()), ("end_idx", pa.int32()), ("level", pa.int32()), ("title", pa.string()),
         ("path", pa.string()), ("line", pa.int32()), ("chars", pa.int64())]


def headings(levels: list[int], gaps: list[int], sizes: list[int], lines: list[int], titles: list[str | None]) -> list[tuple]:
    """Topics in order of TOPIC, from the blocks of a document; a title marks a heading.

    A section ends before the next heading of its level or less. A heading's path has the last heading
    of each lesser level since the last one that was less still. One pass with a stack.
    """
    out: list[list] = []
    open_: list[tuple[int, int, int]] = []  # (place in out, level, bytes before)
    before = 0

    def close(level: int, end: int, upto: int) -> None:
        while open_ and open_[-1][1] >= level:
            k, _, since = open_.pop()
            out[k][1], out[k][6] = end, upto - since

    for i, (level, gap, size, line, title) in enumerate(zip(levels, gaps, sizes, lines, titles)):
        if title is not None:
            close(level, i, before - gaps[i - 1] - 1 if i else 0)
            path = SEPARATOR.join([*(out[k][3] for k, _, _ in open_), title])
            open_.append((len(out), level, before))
            out.append([i, 0, level, title, path, line, 0])
        before += size + gap + 1
    if gaps:
        close(0, len(gaps), before - gaps[-1] - 1)
    return [tuple(x) for x in out]


def with_topics(parsed: DataFrame, blocks: str = "blocks", out: str = "topics") -> DataFrame:
    """``parsed`` with ``out``: the array of topics of each document, see :func:`headings`. No text but titles
    leaves the JVM, and no row is shuffled."""
    slim = F.transform(
        blocks,
        lambda b: F.struct(
            b["level"].alias("level"), b["gap"].alias("gap"), b["n_bytes"].alias("n_bytes"), b["line"].alias("line"),
            F.when(b["kind"] == "heading", heading_title(b["text"])).alias("title"),
        ),
    )
    kind = pa.list_(pa.struct(TOPIC))

    @F.arrow_udf("array<struct<block_idx: int, end_idx: int, level: int, title: string, path: string, line: int, chars: bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [n for n, _ in TOPIC]
        for batch in batches:
            ends, flat = batch.offsets.to_pylist(), batch.values
            fields = [flat.field(i).to_pylist() for i in range(5)]
            rows = [headings(*(f[a:b] for f in fields)) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.array([[dict(zip(names, t)) for t in row] for row in rows], kind)

    return parsed.withColumn(out, run(slim))


def topics(parsed: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """One row per heading: keys, block_idx, end_idx, level, title, path, line, chars (bytes of the section)."""
    rows = with_topics(parsed, blocks, "__topics").select(*keys, F.explode("__topics").alias("__t"))
    return rows.select(*keys, "__t.*")


def outline_text(topics: DataFrame) -> DataFrame:
    """``topics`` with ``rendered``: line, size and the indented title."""
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    return topics.withColumn("rendered", F.format_string("%5d %7d  %s%s", "line", "chars", indent, F.col("title")))


def sections(parsed: DataFrame, addresses: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """``addresses`` (keys, address) resolved: status (found, ambiguous, missing), text, candidates.

    An address is a full path or, if no path matches, a title; case and outer space don't count.
    Several matches are refused and listed; for none, up to eight titles that contain the address.
    """
    found = topics(parsed, keys, blocks)
    want = F.lower(trim(F.col("address")))
    asked = addresses.select(*keys, "address").distinct().withColumn("__want", want)
    joined = asked.join(found, keys, "left")
    joined = joined.withColumn(
        "__rank",
        F.when(F.col("__want") == "", 4)
        .when(F.lower("path") == F.col("__want"), 1)
        .when(F.lower("title") == F.col("__want"), 2)
        .when(F.contains(F.lower("title"), F.col("__want")), 3)
        .otherwise(4),
    )
    hit = F.when(F.col("__rank") < 4, F.struct("block_idx", "end_idx", "path"))
    by = [F.array_sort(F.collect_list(F.when(F.col("__rank") == k, hit))).alias(f"__{k}") for k in (1, 2, 3)]
    got = joined.groupBy(*keys, "address").agg(*by)
    best = F.when(F.size("__1") > 0, F.col("__1")).otherwise(F.col("__2"))
    got = got.withColumn("__best", best)
    n = F.size("__best")
    status = F.when(n == 1, "found").when(n > 1, "ambiguous").otherwise("missing")
    near = F.when(n > 1, F.col("__best")).when(n == 0, F.slice("__3", 1, 8))
    candidates = F.coalesce(F.transform(near, lambda t: t["path"]), F.array().cast("array<string>"))
    got = got.select(*keys, "address", status.alias("status"), candidates.alias("candidates"), "__best")
    place = F.when(F.col("status") == "found", F.get(F.col("__best"), F.lit(0)))
    with_text = got.withColumn("__at", place).join(parsed.select(*keys, F.col(blocks).alias("__blocks")), keys, "left")
    own = F.slice("__blocks", F.col("__at.block_idx") + 1, F.col("__at.end_idx") - F.col("__at.block_idx"))
    with_text = with_text.withColumn("__own", own)
    text = F.when(F.col("status") == "found", render(F.col("__own")))
    return with_text.select(*keys, "address", "status", text.alias("text"), "candidates")
