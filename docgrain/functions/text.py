"""Column expressions on lines and texts of Markdown. Sizes are bytes unless a name says characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text (Unicode), as a class body for Java's engine.
WS = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space inside patterns.
SP = r"[\t\n\f\r ]"

# The patterns that define the dialect.
FENCE = r"(?d)^([ \t]*)(`{3,}|~{3,})(.*)\z"
HEADING = rf"(?d)^ {{0,3}}(#{{1,6}})({SP}|\z)"
TABLE_ROW = r"(?d)^[ \t]*\|.*\|[ \t]*\z"
TABLE_RULE = r"(?d)^[ \t]*\|[ \t:|-]*\|[ \t]*\z"
LIST_ITEM = rf"(?d)^[ \t]*(?:[-*+]|[0-9]{{1,9}}[.)])({SP}|\z)"
CODE_SPAN = "`+[^`]*`+"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>"
HTML_START = r"^ {0,3}<[a-zA-Z/]"
BLOCK_TAGS = (
    "div", "p", "table", "section", "article", "main", "aside", "header", "footer", "nav", "details", "figure",
    "form", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6",
)
PROTECTED = (
    r"`+[^`]*`+|https?://[^\t\n\f\r )]+|\]\([^)]*\)|\]\[[^\]]*\]|\[\^[^\]]+\]|</?[a-zA-Z][^>]*>"
    r"|⟦[\t\n\f\r ]*[0-9]+[\t\n\f\r ]*⟧"
)
FLAG = r"^-{1,2}[\p{L}0-9][\p{L}0-9_-]*\z"
PATH = r"^[.~]?/?[\p{L}0-9_.-]+(?:[/.][\p{L}0-9_.-]+)+/?\z"
STRUCTURAL = r"^[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|[0-9]{1,9}[.)][ \t]|>|\||`{3,}|~{3,})"
LANGUAGES = {
    "de": "German", "en": "English", "es": "Spanish", "fr": "French", "it": "Italian", "pt": "Portuguese",
    "nl": "Dutch", "pl": "Polish", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean",
    "tr": "Turkish", "cs": "Czech", "sv": "Swedish", "da": "Danish",
}
WITHOUT_SPACES = ("zh", "ja", "th", "ko")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def is_blank(line: Column) -> Column:
    return line.rlike(rf"^[{WS}]*\z")


def lines(text: Column) -> Column:
    """The lines of a text: split at line feeds only, a trailing empty one dropped, blank ones emptied."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.when(is_blank(x), "").otherwise(x))
    # the last line is dropped only if it really is empty, so compare before blanks are emptied
    return F.when(text.endswith("\n") | (text == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fence_marker(line: Column) -> Column:
    """The run of fence characters if the line opens a code fence, else ''."""
    marker, info = F.regexp_extract(line, FENCE, 2), F.regexp_extract(line, FENCE, 3)
    return F.when(marker.startswith("`") & info.contains("`"), "").otherwise(marker)


def closes_fence(line: Column, marker: Column) -> Column:
    """Whether the line closes a fence opened by ``marker``: its character, at least as often, alone."""
    body = trim(line)
    return (body != "") & (F.ltrim(body, F.left(marker, F.lit(1))) == "") & (F.length(body) >= F.length(marker))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    """A heading's text without its opening marks; closing marks stay."""
    return trim(F.regexp_replace(trim(line), r"^#+", ""))


def is_table_row(line: Column) -> Column:
    return line.rlike(TABLE_ROW)


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def is_indented(line: Column) -> Column:
    return line.rlike(r"^[ \t]")


def strip_inline(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, CODE_SPAN, ""), COMMENT, "")


def html_balance(line: Column) -> Column:
    """Block tags that the line opens less those that it closes."""
    tags = F.regexp_extract_all(strip_inline(line), F.lit(TAG), F.lit(0))
    names = F.lit(rf"(?i)^</?(?:{'|'.join(BLOCK_TAGS)})[^a-zA-Z0-9]")
    blocks = F.filter(tags, lambda t: F.rlike(t, names))
    opened = F.filter(blocks, lambda t: ~t.startswith("</") & ~t.endswith("/>"))
    closed = F.filter(blocks, lambda t: t.startswith("</"))
    return F.size(opened) - F.size(closed)


def opens_html(line: Column) -> Column:
    return line.rlike(HTML_START) & (html_balance(line) > 0)


def opens_verbatim(line: Column) -> Column:
    low = F.lower(strip_inline(line))
    return low.contains("<pre") | low.contains("<code")


def first_heading(text: Column) -> Column:
    """The first line that looks like a heading, trimmed, or '' (fences aren't looked at)."""
    found = F.filter(F.split(text, "\n", -1), lambda x: heading_level(x) > 0)
    return F.coalesce(trim(F.get(found, F.lit(0))), F.lit(""))


def canonical(text: Column) -> Column:
    """The form that splitting and joining reproduce byte for byte."""
    body = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(is_blank(x), "").otherwise(x)), "\n")
    body = F.regexp_replace(body, r"^\n+|\n+\z", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def normalized(text: Column) -> Column:
    """The tolerant form: outer white space, line ends and runs of blank lines don't count."""
    body = F.regexp_replace(trim(text), r"[ \t\r]+(?=\n|\z)", "")
    body = F.regexp_replace(body, r"\n{3,}", "\n\n")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def is_translatable(text: Column) -> Column:
    """Whether prose is left once protected spans are out: not a flag, not a path, two letters on end."""
    rest = trim(F.regexp_replace(text, PROTECTED, ""))
    return ~rest.rlike(FLAG) & ~rest.rlike(PATH) & rest.rlike(r"\p{L}{2,}")


def is_term(key: Column, value: Column) -> Column:
    """Whether ``value`` can stand for the term ``key``: not a sentence, list or explanation."""

    def count(c: Column) -> Column:
        return F.size(F.filter(F.split(c, rf"[{WS}]+"), lambda w: w != ""))

    plain = ~value.rlike(r"[.!?;\n(]") & ~value.contains(" / ")
    return plain & (count(value) <= count(key) + 3) & (F.char_length(value) <= 4 * F.char_length(key) + 20)


def language_base(code: Column) -> Column:
    low = F.lower(trim(code))
    return F.regexp_replace(low, r"(?s)^([^_-].*?)[-_].*\z", "$1")


def source_support(code: Column) -> Column:
    """How well terms can be found in a source language: good, noisy or none."""
    base = language_base(code)
    return F.when(base.isin("", "en", "english"), "good").when(base.isin(*WITHOUT_SPACES), "none").otherwise("noisy")


def source_note(code: Column) -> Column:
    level = source_support(code)
    return (
        F.when(level == "good", "")
        .when(level == "none", "words are not separated by spaces, so no terms can be found")
        .otherwise("common words of this language are not filtered; review the list")
    )


def language_name(code: Column) -> Column:
    """The name of a language code; anything else stays as it is, trimmed."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(trim(code))), trim(code))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value evaluated once, where a lambda or several branches use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def min_fill(level: Column, size: Column) -> Column:
    """Bytes that a part must hold before a heading of ``level`` may begin the next one."""
    return F.when(level <= 2, F.floor(size / 4)).otherwise(F.floor(size / 2)).cast("int")


#: Characters of a fragment that may be asked for in a list.
SHORT = 60


def is_short_fragment(text: Column, translate: Column) -> Column:
    return translate & (F.char_length(text) <= SHORT)
