"""Parts through a translator: fragments or whole parts out, guarded and verified parts back.

The translator is any function from a list of (system, user) to a list of replies (a Failure, or None,
where there was no usable one). It runs in one Arrow stage; masking, guards, restoring and verification are
column expressions. Requests are deduplicated, so that a repeated fragment is asked for once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import fit, numbered_items, restore, term_pattern, unwrap
from ..functions.text import trim
from ..operators.fragments import with_masked, with_requests
from ..operators.jobs import source_hash
from ..operators.merge import verify
from .requests import FRAGMENT_RULES, LIST_RULES, PART_RULES, default_task, fixed_terms, instruction


@dataclass(frozen=True)
class Failure:
    """What a translator gives in place of a reply: the kind of the failure, and what was said."""

    kind: str
    message: str = ""


Translator = Callable[[list[tuple[str, str]]], list[str | Failure | None]]
#: Requests that a translator gets at a time; their replies go on to Spark before the next ones are asked for.
LOT = 32


@dataclass
class Options:
    """language: code or name; instruction: replaces the task; glossary: term to value; mode: block or chunk."""

    language: str = ""
    source_lang: str = "en"
    instruction: str = ""
    glossary: dict[str, str] = field(default_factory=dict)
    mode: str = "block"
    skip_verify: bool = False
    batch_short: bool = True


REPLY = "struct<reply: string, error_kind: string, error: string>"
FOUND = "struct<reply: string, batched: boolean, error_kind: string, error: string>"


def _outcomes(translator: Translator, pairs: list[tuple[str, str]], lot: int) -> Iterator[dict]:
    """What the translator gives for each pair, asked for ``lot`` at a time: reply, error_kind, error."""
    for at in range(0, len(pairs), lot):
        for got in translator(pairs[at : at + lot]):
            if isinstance(got, Failure):
                yield {"reply": None, "error_kind": got.kind, "error": got.message}
            elif got is None:
                yield {"reply": None, "error_kind": "unknown", "error": "no reply"}
            else:
                yield {"reply": got, "error_kind": None, "error": None}


def ask(translator: Translator, lot: int = LOT):
    """Column function of (system, user): (reply, error_kind, error), a reply or why there is none.

    A null user text isn't asked, and has neither. The function is marked as one whose answers may differ, so
    that a plan evaluates it once; a retried task asks again.
    """

    @F.arrow_udf(REPLY)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            pairs = list(zip(*(c.to_pylist() for c in batch)))
            replies = _outcomes(translator, [p for p in pairs if p[1] is not None], lot)
            kind = pa.struct([(n, pa.string()) for n in ("reply", "error_kind", "error")])
            yield pa.array([next(replies) if user is not None else None for _, user in pairs], kind)

    return run.asNondeterministic()


def ask_open(translator: Translator, lot: int = LOT):
    """Column function of (system, requests: array of (terms, user), listed: array of (at, text)): for each request
    (reply, batched, error_kind, error). Its system prompt is ``system`` and its terms. What is listed (the
    greatest text for a place) isn't asked again."""
    kind = pa.list_(pa.struct([("reply", pa.string()), ("batched", pa.bool_()), ("error_kind", pa.string()), ("error", pa.string())]))

    @F.arrow_udf(f"array<{FOUND}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for system, requests, listed in batches:
            requests, known = requests.to_pylist(), []
            for items in listed.to_pylist():
                known.append({})
                for x in items or ():
                    known[-1][x["at"]] = max(x["text"], known[-1].get(x["at"], x["text"]))
            pairs = [
                (head + x["terms"], x["user"])
                for head, row, have in zip(system.to_pylist(), requests, known) for i, x in enumerate(row) if i not in have
            ]
            replies = _outcomes(translator, pairs, lot)
            yield pa.array([
                [{"reply": have[i], "batched": True} if i in have else {**next(replies), "batched": False} for i in range(len(row))]
                for row, have in zip(requests, known)
            ], kind)

    return run.asNondeterministic()


def _glossary(df: DataFrame, glossary: dict[str, str]) -> list[tuple[str, str]]:
    """(pattern, line) of each entry. Patterns are made once, so that they are constants of the plan."""
    entries = sorted(glossary.items())
    if not entries:
        return []
    row = df.sparkSession.range(1).select(*[term_pattern(F.lit(k)).alias(f"p{i}") for i, (k, _) in enumerate(entries)]).first()
    return [(p, f"- {k} = {v}") for p, (k, v) in zip(row, entries) if p is not None]


def _applied(text: Column, lines: list[tuple[str, str]]) -> Column:
    """The glossary lines whose terms occur in the text."""
    if not lines:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(line)) for p, line in lines]), lambda x: x.isNotNull())


def _task(options: Options, unit: str):
    return F.lit(options.instruction) if options.instruction else default_task(F.lit(options.language), unit)


def by_blocks(parts: DataFrame, keys: list[str], translator: Translator, options: Options) -> DataFrame:
    """Parts rewritten fragment by fragment: keys, source, out, kept (fragments left as they were after an unusable
    reply), error_kind and error (of the first request without a reply), requests, accepted (answered in a list), reused.

    A part's requests and replies stay in its row: no join, and nothing is asked twice. Its pieces are guarded
    as rows and meet again by the keys, the only shuffle. ``out`` is null for a part without any piece.
    """
    lines = _glossary(parts, options.glossary)
    rows = with_requests(parts.select(*keys, F.col("text").alias("source")), "source")
    listed = F.array().cast("array<struct<at: int, text: string>>")
    if options.batch_short:
        masked = lambda at: F.get("work.requests", at)["masked"]
        items = F.transform("work.short", lambda at, i: F.concat((i + 1).cast("string"), F.lit(". "), masked(at), F.lit("\n")))
        system = instruction(_task(options, "each numbered line"), LIST_RULES)
        user = F.when(F.size("work.short") > 1, F.concat_ws("", items))
        rows = rows.withColumn("list", ask(translator)(system, user))

        def fitted(item: Column) -> Column:
            at = F.get("work.short", item["n"] - 1)
            return F.struct(at.alias("at"), fit(F.get("work.requests", at)["text"], item["text"])["text"].alias("text"))

        got = F.transform(numbered_items(F.col("list.reply"), F.size("work.short")), fitted)
        listed = F.coalesce(F.filter(got, lambda x: x["text"].isNotNull()), listed)
    system = instruction(_task(options, "the text below"), FRAGMENT_RULES)
    terms = lambda x: fixed_terms(_applied(x["text"], lines)) if lines else F.lit("")
    asked = F.transform("work.requests", lambda x: F.struct(terms(x).alias("terms"), x["masked"].alias("user")))
    rows = rows.withColumn("replies", ask_open(translator)(system, asked, listed))
    batched = F.size(F.filter("replies", lambda r: r["batched"]))
    once = lambda c: F.when(F.coalesce(F.col("piece_idx"), F.lit(0)) == 0, c)
    rows = rows.withColumn("accepted", batched).select("*", F.posexplode_outer("work.pieces").alias("piece_idx", "p"))
    rows = rows.select(
        *keys, "piece_idx", "p.*", F.get("replies", F.col("p.request")).alias("r"), once(F.col("source")).alias("source"),
        once(F.size("replies")).alias("n"), once(F.col("accepted")).alias("accepted"),
    )
    rows = rows.withColumn("fitted", fit(F.col("text"), trim(F.col("r.reply")))["text"])
    plain = (F.size("tokens") == 0) & ~F.contains("fitted", F.lit("⟦"))
    rows = rows.withColumn("back", F.when(plain, F.col("fitted")).otherwise(restore(F.col("fitted"), F.col("tokens"))["text"]))
    own, silent = F.col("request").isNotNull(), F.col("r.reply").isNull()
    rows = rows.select(
        *keys, "piece_idx", F.coalesce("back", "text").alias("out"), "source", "n", "accepted", own.alias("own"),
        (own & ~silent & F.col("back").isNull()).alias("kept"),
        F.when(own & silent, F.struct("piece_idx", F.coalesce("r.error_kind", F.lit("unknown")).alias("kind"), "r.error")).alias("failed"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece_idx", "out"))), lambda p: p["out"])
    number = lambda name: F.sum(name).cast("long")
    return rows.groupBy(*keys).agg(
        F.max("source").alias("source"),
        F.when(F.count("piece_idx") > 0, F.concat(trim(F.concat_ws("", ordered)), F.lit("\n"))).alias("out"),
        F.count_if("kept").alias("kept"),
        F.min("failed")["kind"].alias("error_kind"),
        F.coalesce(F.min("failed")["error"], F.min("failed")["kind"]).alias("error"),
        number(F.col("n") - F.col("accepted")).alias("requests"), number("accepted").alias("accepted"),
        (F.count_if("own") - number("n")).alias("reused"),
    )


def by_parts(parts: DataFrame, keys: list[str], translator: Translator, options: Options) -> DataFrame:
    """Parts rewritten whole, code and protected spans masked: keys, source, out (null if refused), error_kind,
    error, masked. No row is shuffled."""
    lines = _glossary(parts, options.glossary)
    m = with_masked(parts.select(*keys, F.col("text").alias("source")), "source").select(*keys, "source", "masked.masked", "masked.tokens")
    system = instruction(_task(options, "the Markdown below"), PART_RULES, _applied(F.col("masked"), lines))
    j = m.withColumn("got", ask(translator)(system, F.col("masked"))).select(*keys, "source", "masked", "tokens", "got.*")
    j = j.withColumn("back", restore(trim(unwrap(F.col("reply"), F.col("masked"))), F.col("tokens")))
    out = F.when(F.col("reply").isNotNull() & F.col("back.error").isNull(), F.concat(trim(F.col("back.text")), F.lit("\n")))
    error = F.when(F.col("reply").isNull(), F.coalesce("error", "error_kind")).otherwise(F.col("back.error"))
    kind = F.when(F.col("reply").isNull(), F.col("error_kind")).when(F.col("back.error").isNotNull(), F.lit("markers"))
    # The explode keeps the expression of ``out`` apart from the parser that reads it next.
    return j.select(
        *keys, "source", F.explode(F.array(out)).alias("out"), kind.alias("error_kind"), error.alias("error"), F.size("tokens").alias("masked")
    )


def transform_parts(parts: DataFrame, keys: list[str], translator: Translator, options: Options | None = None) -> DataFrame:
    """Parts (keys, text) through the translator, each from its original text: keys, source, out, reasons,
    accepted (whether ``out`` may be stored as an edit), and the counters of the mode."""
    options = options or Options()
    if options.mode == "chunk":
        made = by_parts(parts, keys, translator, options)
    else:
        made = by_blocks(parts, keys, translator, options)
    checked = verify(made, "source", "out")
    fine = F.col("out").isNotNull() & F.col("error").isNull() & (F.lit(options.skip_verify) | (F.size("reasons") == 0))
    return checked.withColumn("stored", fine)


def as_edits(transformed: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of :func:`transform_parts` that may be stored, as edits: keys, source_hash, text, updated_at.

    An edit belongs to the text that it was made from, so it drops out when the source changes.
    """
    rows = transformed.where("stored")
    return rows.select(*keys, source_hash(F.col("source")).alias("source_hash"), F.col("out").alias("text"), F.lit(at).alias("updated_at"))


def rejections(transformed: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The other rows: keys, source_hash, text (what was refused), reasons (the error, or the findings), updated_at."""
    rows = transformed.where("not stored")
    why = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("reasons"))
    return rows.select(*keys, source_hash(F.col("source")).alias("source_hash"), F.col("out").alias("text"), why.alias("reasons"), F.lit(at).alias("updated_at"))


def identity(requests: list[tuple[str, str]]) -> list[str | None]:
    """The translator that changes nothing: for tests and dry runs."""
    return [user for _, user in requests]
