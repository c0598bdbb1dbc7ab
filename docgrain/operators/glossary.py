"""Terminology: candidates found in documents, cleaned answers, notes and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CODE_SPAN, is_term, language_name, let, trim

# What ends a clause, what a word is, what identifiers look like, what a sentence is.
CLAUSE = r'[,.;:!?()\[\]{}"—–\n]+'
WORD = r"\p{L}[\p{L}0-9-]*"
IDENTIFIER = r"[\p{L}0-9]+(?:[_./-][\p{L}0-9]+)+|[a-z]+[A-Z][\p{L}0-9]*"
SENTENCE = r"[^.!?\n]*[.!?]"
EXAMPLE = 160
LIMIT = 40
#: English words that never begin, end or are a term. A parameter of :func:`candidates`.
STOPWORDS = (
    "about above across again against all almost alone along also although always among and another any anything are "
    "around because been before began being below between beyond both but can cannot could did does doing done down "
    "during each either else enough even ever every everything few first for from further get gets give gives goes had "
    "has have having hence her here him his how however into its itself just keep keeps last later least less let like "
    "made make makes many may means might more most much must near need needs neither never next nor not nothing now "
    "off often once one only onto other our out over own per perhaps put quite rather same see seen several shall she "
    "should since some something still such take takes than that the their them then there these they this those though "
    "through thus together too toward two under until upon use used using very want was way were what when where "
    "whether which while who whole whose why will with within without would yet you your"
).split()


def _terms(clause: Column, stopwords: list[str]) -> Column:
    """The single words and adjacent pairs of a clause that can be terms: (term, word)."""
    stop = F.array(*map(F.lit, stopwords))
    fine = lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w)
    words = F.regexp_extract_all(clause, F.lit(WORD), F.lit(0))

    def pairs(ws: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            low, after = F.lower(w), F.lower(F.get(ws, i + 1))
            one = F.struct(low.alias("term"), w.alias("word"))
            two = F.struct(F.concat(low, F.lit(" "), after).alias("term"), w.alias("word"))
            both = F.coalesce(fine(after), F.lit(False))
            none = F.array().cast("array<struct<term: string, word: string>>")
            return F.when(~fine(low), none).when(both, F.array(one, two)).otherwise(F.array(one))

        return F.flatten(F.transform(ws, at))

    return let(words, pairs)


def code_words(blocks: Column) -> Column:
    """The vocabulary of code: words of inline code, and of identifiers in code blocks; lower case, distinct."""
    word = lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))
    each = F.transform(
        blocks,
        lambda b: F.flatten(F.transform(
            F.when(b["kind"] == "code", F.regexp_extract_all(b["text"], F.lit(IDENTIFIER), F.lit(0)))
            .otherwise(F.regexp_extract_all(b["text"], F.lit(CODE_SPAN), F.lit(0))),
            word,
        )),
    )
    long = F.filter(F.flatten(each), lambda w: F.octet_length(w) >= 3)
    return F.array_distinct(F.transform(long, lambda w: F.lower(w)))


def sentence_around(text: Column, word: Column) -> Column:
    """The first sentence that holds the word, white space collapsed, cut at EXAMPLE bytes (whole characters)."""
    hits = F.filter(
        F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.contains(F.lower(s), F.lower(word))
    )
    flat = trim(F.regexp_replace(F.coalesce(F.get(hits, F.lit(0)), F.lit("")), r"[\t\n\x0B\f\r \x85\xA0]+", " "))
    # A cut inside a character falls back to the character's beginning: drop what no longer decodes.
    cut = F.regexp_replace(F.left(flat, F.lit(EXAMPLE)), "$", "")
    fits = F.octet_length(flat) <= EXAMPLE
    keep = F.aggregate(
        F.sequence(F.lit(1), F.lit(EXAMPLE)), F.lit(0),
        lambda n, i: F.when(F.octet_length(F.substring(flat, F.lit(1), i)) <= EXAMPLE, i).otherwise(n),
    )
    return F.when(fits, flat).otherwise(F.concat(F.substring(cut, F.lit(1), keep), F.lit("…")))


def head_word(term: Column) -> Column:
    return F.substring_index(term, " ", 1)


def is_identifier(term: Column, code: Column) -> Column:
    """Whether a phrase only spells out an identifier of the (lower-case) document."""
    parts = F.split(term, " ")
    join = lambda sep: F.array_join(parts, sep)
    out = F.contains(code, join("_"))
    for sep in ("_", "-", "", "."):
        out = out | F.contains(code, F.concat(join(sep), F.lit("("))) | F.contains(code, F.concat(F.lit("`"), join(sep)))
    return F.contains(term, F.lit(" ")) & out


def candidates(
    parsed: DataFrame, keys: list[str], limit: int = LIMIT, text: str = "text", stopwords: list[str] | None = None
) -> DataFrame:
    """Terms of each document worth a fixed translation, best first: keys, rank, term, blocks, count, in_code,
    score, example.

    Terms are counted over all words and adjacent pairs of prose; each document keeps its ``limit`` best
    after identifiers are dropped, hyphen variants merged and words inside phrases removed.
    """
    stop = STOPWORDS if stopwords is None else stopwords
    by = Window.partitionBy(*keys)
    prose = parsed.select(*keys, F.posexplode("blocks").alias("block_idx", "b")).where(~F.col("b.kind").isin("code", "html"))
    clause = prose.select(
        *keys, "block_idx", F.posexplode(F.split(F.regexp_replace("b.text", CODE_SPAN, " "), CLAUSE, -1)).alias("c", "clause")
    )
    found = clause.select(*keys, "block_idx", "c", F.posexplode(_terms(F.col("clause"), stop)).alias("w", "t"))
    counted = found.groupBy(*keys, F.col("t.term").alias("term")).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_distinct("block_idx").alias("blocks"),
        F.min_by(F.struct("block_idx", "t.word"), F.struct("block_idx", "c", "w")).alias("first"),
    )
    counted = counted.where("blocks >= 2 or count >= 3")
    docs = parsed.select(*keys, "blocks", code_words(F.col("blocks")).alias("__code"), F.lower(text).alias("__low"))
    docs = docs.withColumnRenamed("blocks", "__blocks")
    c = counted.join(docs, keys, "inner")
    phrase = F.contains(F.col("term"), F.lit(" "))
    c = c.withColumn("in_code", F.array_contains("__code", head_word(F.col("term")))).where(phrase | F.col("in_code"))
    score = F.col("blocks") * 3 + F.col("count") + F.when(F.col("in_code"), 8).otherwise(0) + F.when(phrase, 5).otherwise(0)
    example = sentence_around(F.get(F.col("__blocks"), F.col("first.block_idx"))["text"], F.col("first.word"))
    c = c.withColumn("score", score.cast("long")).where(~is_identifier(F.col("term"), F.col("__low")))
    c = c.withColumn("example", example).drop("__blocks", "__code", "__low", "first")
    c = c.withColumn("__rank", F.row_number().over(by.orderBy(F.desc("score"), "term")))
    best = lambda x: F.min_by(x, "__rank").alias(x)
    merged = c.groupBy(*keys, F.replace("term", F.lit("-"), F.lit(" ")).alias("merged")).agg(
        F.sum("count").alias("count"), F.max("blocks").alias("blocks"), best("in_code"), best("score"), best("example"),
        F.min("__rank").alias("__rank"),
    )
    merged = merged.withColumnRenamed("merged", "term")
    in_phrase = F.collect_set(F.when(F.contains(F.col("term"), F.lit(" ")), F.split("term", " "))).over(by)
    merged = merged.withColumn("__in", F.flatten(in_phrase))
    merged = merged.where(F.contains(F.col("term"), F.lit(" ")) | ~F.array_contains("__in", F.col("term")))
    merged = merged.withColumn("rank", F.row_number().over(by.orderBy("__rank"))).where(F.col("rank") <= limit)
    return merged.select(*keys, "rank", "term", "blocks", "count", "in_code", "score", "example")


def notes(found: DataFrame) -> DataFrame:
    """``found`` with ``note``: the evidence for a term."""
    text = F.format_string("%d occurrences in %d chunks", "count", "blocks")
    return found.withColumn("note", F.concat(text, F.when(F.col("in_code"), ", also appears in code").otherwise("")))


def parse_reply(reply: Column) -> Column:
    """The map in a reply: what stands between the first and the last brace, read as JSON; null if there is none."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "map<string,string>")


def clean(answers: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``answers`` (keys, term, value) without entries that are blank, weren't asked for, changed nothing,
    or aren't terms."""
    a = answers.select(*keys, trim(F.col("term")).alias("term"), trim(F.col("value")).alias("value"))
    a = a.where((F.col("term") != "") & (F.col("value") != "") & (F.lower("term") != F.lower("value")))
    a = a.where(is_term(F.col("term"), F.col("value"))).withColumn("__low", F.lower("term"))
    known = asked.select(*keys, F.lower("term").alias("__low")).distinct()
    return a.join(known, [*keys, "__low"], "left_semi").select(*keys, "term", "value")


def term_requests(found: DataFrame, keys: list[str], source_lang: str, target_lang: str) -> DataFrame:
    """One request per document for the terms of :func:`candidates`: keys, id, system, user (term and example per line)."""
    line = F.concat(F.lit("- "), "term", F.when(F.col("example") != "", F.concat(F.lit(": "), "example")).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    name = lambda c: language_name(F.lit(c))
    system = F.concat(F.lit("You fix terminology. For each term give its translation from "), name(source_lang), F.lit(" into "),
                      name(target_lang), F.lit(", as one JSON object from term to translation and nothing else. Keep product names."))
    rows = found.groupBy(*keys).agg(F.array_join(lines, "\n").alias("user"))
    return rows.select(*keys, F.sha2(F.concat_ws("\x1e", *[F.col(k).cast("string") for k in keys]), 256).alias("id"), system.alias("system"), "user")


def build(found: DataFrame, keys: list[str], translator, source_lang: str, target_lang: str) -> DataFrame:
    """The glossary of each document: keys, term, value, note. Documents without a usable reply have none."""
    from ..plans.transform import ask

    requests = term_requests(found, keys, source_lang, target_lang)
    replies = requests.select(*keys, ask(translator)(F.col("system"), F.col("user"))["reply"].alias("reply")).where("reply is not null")
    answers = replies.select(*keys, F.explode(parse_reply(F.col("reply"))).alias("term", "value"))
    told = notes(found).select(*keys, F.lower("term").alias("__low"), "note")
    return clean(answers, found, keys).withColumn("__low", F.lower("term")).join(told, [*keys, "__low"], "left").drop("__low")


def sorted_terms(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Glossaries as text, a line for each term, in order: keys, listing."""
    line = F.struct("term", F.concat("term", F.lit(" = "), "value").alias("line"))
    rows = entries.groupBy(*keys).agg(F.array_sort(F.collect_set(line)).alias("lines"))
    return rows.select(*keys, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("listing"))


def to_file(entries: DataFrame, keys: list[str], source_lang: str, target_lang: str, model: str = "", generated: str = "") -> DataFrame:
    """Glossaries as JSON documents: keys, json, with the notes of entries that have any."""
    has = "note" in entries.columns
    note = F.when(F.col("note") != "", F.struct("term", "note")) if has else F.lit(None).cast("struct<term: string, note: string>")
    pairs = lambda x: F.map_from_entries(F.array_sort(F.collect_list(x)))
    made = entries.groupBy(*keys).agg(pairs(F.struct("term", "value")).alias("terms"), pairs(note).alias("notes"))
    head = [F.lit(v or None).cast("string").alias(n) for n, v in (
        ("source_lang", source_lang), ("target_lang", target_lang), ("model", model), ("generated", generated))]
    body = F.struct(*head, "terms", F.when(F.size("notes") > 0, F.col("notes")).alias("notes"))
    return made.select(*keys, F.to_json(body).alias("json"))


def from_file(files: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of glossary documents (keys, json): keys, term, value, note, model, generated."""
    schema = "source_lang string, target_lang string, model string, generated string, terms map<string,string>, notes map<string,string>"
    read = files.select(*keys, F.from_json("json", schema).alias("g"))
    rows = read.select(*keys, "g", F.explode("g.terms").alias("term", "value"))
    return rows.select(*keys, "term", "value", F.try_element_at("g.notes", "term").alias("note"), "g.model", "g.generated")
