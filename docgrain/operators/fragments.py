"""Parts to the fragments that may be rewritten, and to masked texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROTECTED, SHORT
from .blocks import SPACE, parse

_S = "".join(c for c in SPACE if c != "\n")
#: A fence inside a list: its opening line, the lines to its end, and the closing one if there is one.
_FENCED = (
    rf"^[{_S}]*+(?P<run>(?P<mark>[`~])(?P=mark){{2,}}+)[^\n]*+"
    rf"(?:\n(?![{_S}]*+(?P=run)(?P=mark)*+[{_S}]*+$)[^\n]*+)*+(?:\n[{_S}]*+(?P=run)(?P=mark)*+[{_S}]*+$)?"
)
#: What is syntax, and not language, in blocks of a kind; what stands between may be rewritten.
_SYNTAX = {
    "heading": regex.compile(r"\A {0,3}#{1,6}[ \t]+"),
    "table": regex.compile(r"^[ \t]*\|[ \t:|-]*\|[ \t]*$|\||\n", regex.M),
    "list": regex.compile(rf"{_FENCED}|\n|^[ \t]*(?:[-*+]|[0-9]{{1,9}}[.)])[ \t]+", regex.M),
}
_HELD = regex.compile(_FENCED, regex.M)
_CORE = regex.compile(rf"([{SPACE}]*+)(.*?)([{SPACE}]*)", regex.S)
_PROTECTED = regex.compile(PROTECTED)
_FLAG = regex.compile(r"-{1,2}[\p{L}0-9][\p{L}0-9_-]*\Z")
_PATH = regex.compile(r"[.~]?/?[\p{L}0-9_.-]+(?:[/.][\p{L}0-9_.-]+)+/?\Z")
_LETTERS = regex.compile(r"\p{L}{2,}")


def is_prose(text: str) -> bool:
    """Whether a fragment has language in it once protected spans are out."""
    rest = _PROTECTED.sub("", text).strip(SPACE)
    return not _FLAG.match(rest) and not _PATH.match(rest) and _LETTERS.search(rest) is not None


def _tokens(kind: str, text: str) -> Iterator[tuple[str, bool]]:
    """Runs of a block's text, in order: (text, may be rewritten?)."""
    syntax = _SYNTAX.get(kind)
    if kind == "prose" or (kind == "heading" and not syntax.match(text)):
        yield text, True
    elif syntax is None:
        yield text, False
    else:
        at = 0
        for m in [*syntax.finditer(text), None]:
            before, core, after = _CORE.fullmatch(text[at : m.start() if m else len(text)]).groups()
            yield from ((before, False), (core, is_prose(core)), (after, False))
            if m:
                yield m[0], False
                at = m.end()


def _rendered(part: str | None) -> Iterator[tuple[str, str]]:
    """(kind, text) of the blocks of a part, with what stands between two of them as kind ''."""
    blocks = parse(part)
    for i, b in enumerate(blocks):
        yield b["kind"], b["text"]
        if i + 1 < len(blocks):
            yield "", "\n" * (b["gap"] + 1)


def pieces(part: str | None) -> list[tuple[str, bool]]:
    """(text, may be rewritten?) of a part, in order; the texts concatenate to its rendered blocks."""
    out: list[tuple[str, bool]] = []
    for kind, block in _rendered(part):
        for text, free in _tokens(kind, block):
            if text and out and not free and not out[-1][1]:
                out[-1] = (out[-1][0] + text, False)
            elif text:
                out.append((text, free))
    return out


def mask_part(part: str | None) -> tuple[str, list[str]]:
    """A whole part with code, HTML and protected spans replaced by markers of one numbering, and what
    they stand for. Fences inside lists count as code; protected spans don't cross lines there."""
    saved: list[str] = []

    def keep(m: regex.Match | str) -> str:
        saved.append(m if isinstance(m, str) else m[0])
        return f"⟦{len(saved) - 1}⟧"

    def masked(kind: str, text: str) -> str:
        if kind in ("code", "html"):
            return keep(text)
        if kind != "list":
            return _PROTECTED.sub(keep, text)
        out, at = [], 0
        for m in [*_HELD.finditer(text), None]:
            out += ["\n".join(_PROTECTED.sub(keep, row) for row in text[at : m.start() if m else len(text)].split("\n"))]
            if m:
                out.append(keep(m))
                at = m.end()
        return "".join(out)

    return "".join(masked(kind, text) for kind, text in _rendered(part)), saved


def requests_of(part: str | None) -> dict[str, list]:
    """Pieces (text, request, tokens) of a part; its requests (text, masked): each masked text that may be
    rewritten, once; and the places of short requests. A piece names its request by place (null: it stays as it
    is) and has its own protected spans."""
    places: dict[str, int] = {}
    rows, asked = [], []
    for text, free in pieces(part):
        if not free:
            rows.append({"text": text, "request": None, "tokens": None})
            continue
        saved = [m[0] for m in _PROTECTED.finditer(text)]
        number = iter(range(len(saved)))
        masked = _PROTECTED.sub(lambda m: f"⟦{next(number)}⟧", text)
        if masked not in places:
            places[masked] = len(asked)
            asked.append({"text": text, "masked": masked})
        rows.append({"text": text, "request": places[masked], "tokens": saved})
    return {"pieces": rows, "requests": asked, "short": [i for i, x in enumerate(asked) if len(x["text"]) <= SHORT]}


def with_requests(parts: DataFrame, text: str = "text", out: str = "work") -> DataFrame:
    """``parts`` with ``out``: (pieces, requests, short) of each part, see :func:`requests_of`."""
    piece = pa.struct([("text", pa.string()), ("request", pa.int32()), ("tokens", pa.list_(pa.string()))])
    request = pa.struct([("text", pa.string()), ("masked", pa.string())])
    kind = pa.struct([("pieces", pa.list_(piece)), ("requests", pa.list_(request)), ("short", pa.list_(pa.int32()))])

    @F.arrow_udf(
        "struct<pieces: array<struct<text: string, request: int, tokens: array<string>>>, "
        "requests: array<struct<text: string, masked: string>>, short: array<int>>"
    )
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([requests_of(x.as_py()) for x in texts], kind)

    return parts.withColumn(out, run(F.col(text)))


def with_masked(parts: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """``parts`` with ``out``: (masked, tokens) of each whole part."""
    kind = pa.struct([("masked", pa.string()), ("tokens", pa.list_(pa.string()))])

    @F.arrow_udf("struct<masked: string, tokens: array<string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([dict(zip(("masked", "tokens"), mask_part(x.as_py()))) for x in texts], kind)

    return parts.withColumn(out, run(F.col(text)))
