"""Protected spans: masked before a text is rewritten, put back and checked after."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PROTECTED, STRUCTURAL, let, trim

MARKER = r"⟦[\t\n\f\r ]*([0-9]+)[\t\n\f\r ]*⟧"
BLANK_LINE = r"\n[ \t]*\n[\t\n\f\r ]*"
# Phrases of the instructions that show up in replies which echo them.
ECHO = (
    r"(?iu)output only the result|no commentary, no explanation|reproduce each exactly once|fragment of a larger document"
    r"|markdown emphasis|sind platzhalter|weder sätze"
)
NUMBERED = r"(?d)^[\t\n\f\r ]*([0-9]+)[\t\n\f\r ]*[.):\-][\t\n\f\r ]*(.*)\z"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))


def mask(text: Column, first: Column | int = 0) -> Column:
    """The text with its k-th protected span replaced by the marker of number ``first`` + k."""
    start = F.lit(first) if isinstance(first, int) else first
    marked = lambda rest: F.transform(
        rest,
        lambda s, i: F.when(i + 1 < F.size(rest), F.concat(s, F.lit("⟦"), (i + start).cast("string"), F.lit("⟧"))).otherwise(s),
    )
    return F.concat_ws("", let(F.split(text, PROTECTED, -1), marked))


def restore(text: Column, saved: Column) -> Column:
    """(text, error): markers replaced by their spans in one pass; an error names the least marker that is
    lost, repeated, or was never sent, and leaves the text null."""
    n = F.size(saved)
    places = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    def trouble(found: Column) -> Column:
        times = lambda i: F.size(F.filter(found, lambda m: m == i))
        wrong = F.get(F.filter(places, lambda i: times(i) != 1), F.lit(0))
        unknown = F.array_min(F.filter(found, lambda m: m >= n))
        return (
            F.when(wrong.isNotNull(), F.format_string("marker %d came back %d times, expected once", wrong, times(wrong)))
            .when(unknown.isNotNull(), F.format_string("marker %d was never sent", unknown))
            .otherwise("marker without a usable number")
        )

    def body(plain: Column) -> Column:
        def put(found: Column) -> Column:
            fine = F.array_sort(found) == places
            both = F.arrays_zip(F.split(plain, MARKER, -1).alias("s"), found.alias("m"))
            spans = F.transform(both, lambda x: F.concat(x["s"], F.coalesce(F.get(saved, x["m"].cast("int")), F.lit(""))))
            error = F.when(plain.isNull(), F.lit("no text")).when(~fine, trouble(found))
            return F.struct(F.when(fine, F.concat_ws("", spans)).alias("text"), error.alias("error"))

        return let(F.transform(F.regexp_extract_all(plain, F.lit(MARKER), F.lit(1)), lambda d: d.try_cast("bigint")), put)

    return let(F.regexp_replace(text, MARKER, "⟦$1⟧"), body)


def fit(source: Column, reply: Column) -> Column:
    """(text, error): a reply in the shape of the fragment that it stands for, or why it can't be."""
    flat = trim(F.regexp_replace(F.regexp_replace(reply, "\n", " "), r"[\t\n\x0B\f\r \x85\xA0]+", " "))
    one = F.when(~source.contains("\n") & reply.contains("\n"), flat).otherwise(reply)
    out = F.when(source.rlike(BLANK_LINE), one).otherwise(F.regexp_replace(one, BLANK_LINE, "\n"))
    error = (
        F.when(out.rlike(STRUCTURAL) & ~source.rlike(STRUCTURAL), "new structure")
        .when(out.rlike(ECHO) & ~source.rlike(ECHO), "echo of the instructions")
        .when(F.char_length(out) > 4 * F.char_length(source) + 80, "too long")
    )
    return F.struct(F.when(error.isNull(), out).alias("text"), error.alias("error"))


def numbered_items(reply: Column, n: Column) -> Column:
    """Items (number from 1 to ``n``, text) of a numbered reply; other lines don't count."""
    rows = F.transform(
        F.split(reply, "\n", -1),
        lambda x: F.struct(
            F.regexp_extract(x, NUMBERED, 1).try_cast("int").alias("n"), trim(F.regexp_extract(x, NUMBERED, 2)).alias("text")
        ),
    )
    return F.filter(rows, lambda r: r["n"].isNotNull() & (r["n"] >= 1) & (r["n"] <= n) & (r["text"] != ""))


def fence_run(line: Column) -> Column:
    """The fence characters that a line begins with, whatever follows them, or ''."""
    return F.regexp_extract(trim(line), r"^(`{3,}|~{3,})", 1)


def unwrap(reply: Column, source: Column) -> Column:
    """A reply without a code fence round the whole of it, unless the source begins with one itself."""
    def inner(rows: Column) -> Column:
        n = F.size(rows)
        marker = fence_run(F.get(rows, F.lit(0)))
        last = trim(F.get(rows, n - 1))
        ends = last.startswith(marker) & (F.regexp_replace(last, "^`+$|^~+$", "") == "")
        whole = (n >= 3) & (marker != "") & ends & (fence_run(F.get(F.split(trim(source), "\n", 2), F.lit(0))) == "")
        return F.when(whole, F.array_join(F.slice(rows, 2, F.greatest(n - 2, F.lit(0))), "\n")).otherwise(reply)

    return let(F.split(trim(reply), "\n", -1), inner)


def term_pattern(term: Column) -> Column:
    """The pattern that finds a term: its words over spaces or hyphens, the last with or without plural,
    whole words only, in any case. Null for a term without words."""
    parts = F.filter(F.split(trim(term), r"[\t\n\x0B\f\r ]+"), lambda w: w != "")
    quote = lambda w: F.regexp_replace(w, r"([\\.+*?()|\[\]{}^$-])", r"\\$1")
    n = F.size(parts)

    def word(w: Column, i: Column) -> Column:
        stem = F.regexp_replace(w, r"s\z", "")
        plural = (i + 1 == n) & (F.octet_length(stem) >= 3)
        return F.when(plural, F.concat(quote(stem), F.lit("(?:e?s)?"))).otherwise(quote(w))

    body = F.array_join(F.transform(parts, word), r"[\t\n\f\r -]+")
    return F.when(
        n > 0, F.concat(F.lit(r"(?iu)(?<![0-9A-Za-z_])"), body, F.lit(r"(?![0-9A-Za-z_])"))
    )


def applies(term: Column, fragment: Column) -> Column:
    return F.coalesce(F.rlike(fragment, term_pattern(term)), F.lit(False))
