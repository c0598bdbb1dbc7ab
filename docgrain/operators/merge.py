"""Parts back to documents, the round-trip verdict, and structural verification of rewritten parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical, is_blank, normalized
from .blocks import with_blocks

def join_parts(parts: Column) -> Column:
    """An array of (text, gap) in order to one text. ``gap``: recorded blank lines before the part, by its
    own place; one where it is unknown or less. Blank parts drop out."""
    cut = F.transform(
        parts, lambda p: F.struct(F.regexp_replace(p["text"], r"^\n+|\n+\z", "").alias("text"), p["gap"].alias("gap"))
    )
    kept = F.filter(cut, lambda p: ~is_blank(F.regexp_replace(p["text"], "\n", " ")))
    glued = F.transform(
        kept,
        lambda p, i: F.concat(
            F.when(i == 0, "").otherwise(F.repeat(F.lit("\n"), F.greatest(F.coalesce(p["gap"], F.lit(1)), F.lit(1)) + 1)),
            p["text"],
        ),
    )
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.concat_ws("", glued), F.lit("\n")))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Part rows (keys, part, text, gap_after) to documents (keys, n_parts, text).

    The parts of one document meet in one row, as its text has to; documents are dealt over tasks.
    """
    item = F.struct("part", "text", "gap_after")
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    with_gap = F.transform(
        "items", lambda p, i: F.struct(p["text"].alias("text"), F.get(F.col("items"), i - 1)["gap_after"].alias("gap"))
    )
    return rows.select(*keys, F.size("items").alias("n_parts"), join_parts(with_gap).alias("text"))


def roundtrip_verdict(source: Column, merged: Column) -> Column:
    """How a merged text compares with its source: exact, up to white space, or different."""
    same = canonical(source) == canonical(merged)
    near = normalized(source) == normalized(merged)
    return F.when(same, "byte-exact").when(near, "whitespace-only").otherwise("different")


FINDING = "array<struct<code: string, at: int, was: string, now: string>>"


def structure_findings(source: Column, rewritten: Column) -> Column:
    """Where rewritten blocks no longer have the shape of the source's: array of (code, at, was, now).

    ``count``: another number of blocks (at 0); ``kind``, ``code``, ``level``, ``rows``: what differs in the
    block at that place (from 1), the first that applies, with both values. Code must come back as it was.
    """
    n, m = F.size(source), F.size(rewritten)
    found = lambda code, at, was, now: F.struct(
        F.lit(code).alias("code"), at.cast("int").alias("at"), was.cast("string").alias("was"), now.cast("string").alias("now")
    )

    def compare(x: Column, i: Column) -> Column:
        a, b, both = x["a"], x["b"], x["a"]["kind"]
        rows = lambda y: y["n_newlines"] + 1
        return (
            F.when(a["kind"] != b["kind"], found("kind", i + 1, a["kind"], b["kind"]))
            .when((both == "code") & (a["text"] != b["text"]), found("code", i + 1, F.md5(a["text"]), F.md5(b["text"])))
            .when((both == "heading") & (a["level"] != b["level"]), found("level", i + 1, a["level"], b["level"]))
            .when((both == "table") & (rows(a) != rows(b)), found("rows", i + 1, rows(a), rows(b)))
        )

    shared = F.least(n, m)
    pairs = F.arrays_zip(F.slice(source, 1, shared).alias("a"), F.slice(rewritten, 1, shared).alias("b"))
    each = F.filter(F.transform(pairs, compare), lambda x: x.isNotNull())
    count = F.when(n != m, F.array(found("count", F.lit(0), n, m))).otherwise(F.array().cast(FINDING))
    return F.concat(count, each)


def reason(finding: Column) -> Column:
    """A finding in words."""
    code, at, was, now = (finding[x] for x in ("code", "at", "was", "now"))
    at = at.cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return (
        F.when(code == "count", say("expected ", was, " blocks but got ", now))
        .when(code == "kind", say("at block ", at, ": ", was, " expected, ", now, " found"))
        .when(code == "code", say("at block ", at, ": the code isn't the same any more"))
        .when(code == "level", say("at block ", at, ": heading level ", was, " expected, ", now, " found"))
        .otherwise(say("at block ", at, ": table of ", was, " rows expected, ", now, " found"))
    )


def verify(pairs: DataFrame, source: str = "source", rewritten: str = "rewritten") -> DataFrame:
    """``pairs`` with ``findings`` and ``reasons`` (the same in words); empty arrays mean that the structure
    held. Both texts are parsed in the row, so the positional comparison needs no join."""
    parsed = with_blocks(with_blocks(pairs, source, "__a"), rewritten, "__b")
    parsed = parsed.withColumn("findings", structure_findings(F.col("__a"), F.col("__b"))).drop("__a", "__b")
    return parsed.withColumn("reasons", F.transform("findings", reason))
