"""Documents to atomic blocks.

The parser is an automaton over classified lines: each line is read once, and either extends the
open block or closes it and opens the next. It runs in an Arrow function of a single text column,
so the blocks of a document stay in its row: grouping, packing, outlines and rendering that follow
need no shuffle at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLOCK_TAGS

KINDS = ("prose", "heading", "code", "table", "list", "html")
BLOCK = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("gap", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("n_bytes", T.IntegerType()),
    T.StructField("n_newlines", T.IntegerType()),
    T.StructField("line", T.IntegerType()),
])
_ARROW = pa.list_(pa.struct([
    ("kind", pa.string()), ("level", pa.int32()), ("gap", pa.int32()), ("text", pa.string()),
    ("n_bytes", pa.int32()), ("n_newlines", pa.int32()), ("line", pa.int32()),
]))

#: White space at the ends of lines (Unicode).
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)\Z", re.S)
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[\t\n\f\r ]|\Z)")
_ROW = re.compile(r"[ \t]*\|.*\|[ \t]*\Z", re.S)
_ITEM = re.compile(r"[ \t]*(?:[-*+]|[0-9]{1,9}[.)])(?:[\t\n\f\r ]|\Z)")
_HTML = re.compile(r" {0,3}<[a-zA-Z/]")
_SPAN, _COMMENT = re.compile("`+[^`]*`+"), re.compile("<!--.*?-->", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>")
_TAGS = frozenset(BLOCK_TAGS)


def fence_marker(line: str) -> str:
    """The fence characters of a line that opens a code fence, else ''."""
    m = _FENCE.match(line)
    if m is None or (m[1][0] == "`" and "`" in m[2]):
        return ""
    return m[1]


def closes(line: str, marker: str) -> bool:
    body = line.strip(SPACE)
    return len(body) >= len(marker) and not body.strip(marker[0])


def html_balance(line: str) -> int:
    """Opened less closed block tags, and whether verbatim text begins, ignoring code spans and comments."""
    total = 0
    for m in _TAG.finditer(_COMMENT.sub("", _SPAN.sub("", line))):
        if m[2].lower() in _TAGS:
            total += -1 if m[1] else 0 if m[0].endswith("/>") else 1
    return total


def is_verbatim(line: str) -> bool:
    low = _COMMENT.sub("", _SPAN.sub("", line)).lower()
    return "<pre" in low or "<code" in low


def _class_of(line: str) -> tuple[str, int | str]:
    """What a line begins if it begins a block, with the heading level, fence marker or tag balance."""
    head = line.lstrip(" \t")[:1]
    if head in "`~" and (marker := fence_marker(line)):
        return "code", marker
    if head == "<" and _HTML.match(line) and (balance := html_balance(line)) > 0:
        return "html", balance
    if head == "#" and (m := _HEADING.match(line)):
        return "heading", len(m[1])
    if head == "|" and _ROW.match(line):
        return "table", 0
    if (head in "-*+" or head.isdigit()) and _ITEM.match(line):
        return "list", 0
    return "prose", 0


class _Open:
    """The block that is being read."""

    __slots__ = ("balance", "fence", "kind", "level", "line", "rows", "verbatim")

    def __init__(self, line: int, text: str, kind: str, value: int | str):
        self.line, self.rows, self.kind = line, [text], kind
        self.level = value if kind == "heading" else 0
        self.fence = value if kind == "code" else ""
        self.balance = value if kind == "html" else 0
        self.verbatim = kind == "html" and is_verbatim(text)

    def takes(self, text: str, kind: str, value: int | str, blanks: int) -> bool:
        """Whether a line that isn't blank, after ``blanks`` blank ones, belongs to this block."""
        if self.kind == "prose":
            return not blanks and kind == "prose"
        if self.kind == "table":
            return not blanks and kind == "table"
        if self.kind == "list":
            if blanks and (kind == "list" or _ITEM.match(text) or text[0] not in " \t"):
                return False
            if kind == "code":
                self.fence = value
            return kind in ("code", "list", "prose")
        if self.kind == "html":
            if self.balance <= 0 or blanks > 1 or (not self.verbatim and _HEADING.match(text)):
                return False
            self.verbatim = self.verbatim or is_verbatim(text)
            self.balance += html_balance(text)
            return True
        return False


def scan(text: str | None) -> list[tuple]:
    """The blocks of one document, in order, as tuples in order of BLOCK; see :func:`parse`."""
    done: list[tuple[_Open, int]] = []
    now: _Open | None = None
    blanks = 0
    rows = (text or "").split("\n")
    if rows[-1] == "":
        rows.pop()
    for i, row in enumerate(rows):
        blank = not row.strip(SPACE)
        if blank:
            row = ""
        if now is not None and now.fence:  # inside a fence nothing else counts
            now.rows += [""] * blanks + [row]
            blanks = 0
            if not blank and closes(row, now.fence):
                now.fence = ""
            continue
        if blank:
            blanks += 1
            continue
        kind, value = _class_of(row)
        if now is not None and now.takes(row, kind, value, blanks):
            now.rows += [""] * blanks + [row]
            blanks = 0
            continue
        if now is not None:
            done.append((now, blanks))
        now, blanks = _Open(i + 1, row, kind, value), 0
    if now is not None:
        if now.kind != "code":
            while now.rows[-1] == "":
                now.rows.pop()
        done.append((now, 0))
    out = []
    for b, gap in done:
        body = "\n".join(b.rows)
        size = len(body) if body.isascii() else len(body.encode("utf-8", "surrogatepass"))
        out.append((b.kind, b.level, gap, body, size, len(b.rows) - 1, b.line))
    return out


def parse(text: str | None) -> list[dict]:
    """The blocks of one document, in order; see BLOCK. ``line`` is the block's first line, from 1.

    Blank lines between blocks are the ``gap`` of the first of them; the last block's gap is 0. A
    fence that is never closed runs to the end, blank lines included. Null and blank texts have none.
    """
    return [dict(zip(BLOCK.names, b)) for b in scan(text)]


def parse_column():
    """Column function: text to array of BLOCK."""

    @F.arrow_udf(T.ArrayType(BLOCK))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        struct = _ARROW.value_type
        for texts in batches:
            flat, ends = [], [0]
            for text in texts:
                flat += scan(text.as_py())
                ends.append(len(flat))
            columns = list(zip(*flat)) if flat else [()] * struct.num_fields
            arrays = [pa.array(c, struct.field(i).type) for i, c in enumerate(columns)]
            blocks = pa.StructArray.from_arrays(arrays, fields=list(struct))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks)

    return run


def with_blocks(docs: DataFrame, text: str = "text", out: str = "blocks") -> DataFrame:
    """``docs`` with ``out``: the array of blocks of each text."""
    return docs.withColumn(out, parse_column()(F.col(text)))


def block_rows(parsed: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """One row per block: the keys, block_idx (from 0) and the fields of BLOCK."""
    return parsed.select(*keys, F.posexplode(blocks).alias("block_idx", "b")).select(*keys, "block_idx", "b.*")


def render(blocks: Column) -> Column:
    """The text of consecutive blocks, with their gaps between them."""
    return F.concat_ws(
        "",
        F.transform(
            blocks,
            lambda b, i: F.when(i + 1 < F.size(blocks), F.concat(b["text"], F.repeat(F.lit("\n"), b["gap"] + 1)))
            .otherwise(b["text"]),
        ),
    )


def register_sql(spark) -> None:
    """Registers the table function ``md_blocks(text)`` for SQL, to be used with LATERAL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="block_idx int, kind string, level int, gap int, text string, n_bytes int, n_newlines int, line int")
    class MdBlocks:
        def eval(self, text: str):
            for i, b in enumerate(scan(text)):
                yield (i, *b)

    spark.udtf.register("md_blocks", MdBlocks)
