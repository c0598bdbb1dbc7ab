"""Jobs: manifests of split documents, edits of parts, progress, staleness, provenance and stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, trim
from .merge import join_parts, roundtrip_verdict, verify

TOOL, VERSION, URL = "docgrain", "0.1.0", ""
STAMP_KEY = "translation:"


def job_id(path: Column, size: Column) -> Column:
    """A stable id of (source path, size)."""
    return F.substring(F.sha2(F.concat(path, F.lit("|"), size.cast("string")), 256), 1, 10)


def source_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    found = F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1)
    return F.when(found == "", ".md").otherwise(found)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def part_file(path: Column, part: Column) -> Column:
    return F.format_string("%s-part-%02d%s", stem(path), part, extension(path))


def edited_file(file: Column, target: Column) -> Column:
    """Where the edited version of a part stands: beside it, named by the target (or 'out')."""
    to = F.when(F.coalesce(target, F.lit("")) == "", "out").otherwise(target)
    return F.concat(F.regexp_replace(file, r"\.[^.]*\z", ""), F.lit("."), to, F.regexp_extract(file, r"(\.[^.]*)\z", 1))


def merged_file(source: Column, target: Column) -> Column:
    """What a merged document is called."""
    named = F.concat(stem(source), F.lit("."), target, extension(source))
    return (
        F.when(F.coalesce(source, F.lit("")) == "", "merged.md")
        .when(F.coalesce(target, F.lit("")) == "", F.concat(source, F.lit(".merged")))
        .otherwise(named)
    )


def manifests(parts: DataFrame, docs: DataFrame, size: int, key: str = "doc_id", path: str = "path", target: str = "") -> DataFrame:
    """One row per document: job_id, source_file, total_parts, size, target, gaps, parts (part, file, chars,
    heading), source_sha256, source_chars and provenance. No body text."""
    item = F.struct(
        "part", F.col("n_bytes").alias("chars"), F.when(F.col("heading") != "", F.col("heading")).alias("heading"), "gap_after"
    )
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    heads = docs.select(key, F.col(path).alias("source_file"), source_hash(F.col("text")).alias("source_sha256"),
                        F.octet_length("text").alias("source_chars"))
    m = heads.join(rows, key, "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<part: int, chars: int, heading: string, gap_after: int>>"))
    )
    source = F.col("source_file")
    full = F.transform(
        "items",
        lambda p: F.struct(
            p["part"].alias("part"), part_file(source, p["part"]).alias("file"), p["chars"].alias("chars"), p["heading"].alias("heading")
        ),
    )
    gaps = F.filter(F.transform("items", lambda p: p["gap_after"]), lambda g: g.isNotNull())
    return m.select(
        job_id(source, F.lit(size)).alias("job_id"), *([] if key == "job_id" else [key]), source.alias("source_file"),
        F.size("items").alias("total_parts"), F.lit(size).alias("size"), F.lit(target).alias("target"),
        gaps.alias("gaps"), full.alias("parts"), "source_sha256", "source_chars",
        F.struct(
            F.lit(TOOL).alias("tool"), F.lit(VERSION).alias("version"), F.lit(URL).alias("url"),
            base_name(source).alias("source"), "source_sha256", "source_chars",
        ).alias("provenance"),
    )


def latest_edits(edits: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """The newest edit of each part; blank texts are no edits."""
    ok = edits.where(trim(F.col("text")) != "")
    return ok.groupBy(*keys).agg(F.max_by("text", order).alias("edited_text"))


def with_edits(parts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` with their edits: ``edited`` and ``current`` (the edit, or else the original)."""
    j = parts.join(latest_edits(edits, keys), keys, "left")
    return j.withColumn("edited", F.col("edited_text").isNotNull()).withColumn(
        "current", F.coalesce("edited_text", "text")
    ).drop("edited_text")


def open_parts(parts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    return parts.join(latest_edits(edits, keys), keys, "left_anti")


def done_parts(parts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    return parts.join(latest_edits(edits, keys), keys, "left_semi")


def status(parts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Progress per job: done, total, missing (parts in order, comma-separated) and a summary."""
    group = [k for k in keys if k != "part"]
    s = with_edits(parts, edits, keys).groupBy(*group).agg(
        F.count_if("edited").alias("done"), F.count(F.lit(1)).alias("total"),
        F.sort_array(F.collect_list(F.when(~F.col("edited"), F.col("part")))).alias("open"),
    )
    missing = F.array_join(F.transform("open", lambda p: p.cast("string")), ", ")
    return s.select(*group, "done", "total", missing.alias("missing"), F.format_string("%d/%d", "done", "total").alias("summary"))


def staleness(jobs: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``jobs`` with ``state``: whether the source has changed since the split (unknown without a hash)."""
    now = sources.select(key, source_hash(F.col("text")).alias("__now"))
    old = F.coalesce("source_sha256", F.lit(""))
    state = F.when((old == "") | F.col("__now").isNull(), "unknown").when(old == F.col("__now"), "unchanged").otherwise("changed")
    return jobs.join(now, key, "left").withColumn("state", state).drop("__now")


def merge_job(parts: DataFrame, edits: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents from current parts: group keys, merged, n_edited, n_parts, verdict (only without edits)."""
    group = [k for k in keys if k != "part"]
    item = F.struct("part", F.col("current").alias("text"), "gap_after", "edited")
    rows = with_edits(parts, edits, keys).groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    with_gap = F.transform(
        "items", lambda p, i: F.struct(p["text"].alias("text"), F.get(F.col("items"), i - 1)["gap_after"].alias("gap"))
    )
    merged = rows.select(
        *group, F.size("items").alias("n_parts"), F.size(F.filter("items", lambda p: p["edited"])).alias("n_edited"),
        join_parts(with_gap).alias("merged"),
    )
    m = merged.join(docs.select(*group, F.col("text").alias("__source")), group, "left")
    verdict = F.when(F.col("n_edited") == 0, roundtrip_verdict(F.col("__source"), F.col("merged")))
    return m.withColumn("verdict", verdict).drop("__source")


def record_run(jobs: DataFrame, language: str, model: str, mode: str, at: str) -> DataFrame:
    """``jobs`` whose provenance names a run."""
    p = F.col("provenance")
    for name, value in (("target_lang", language), ("model", model), ("mode", mode), ("translated", at), ("machine_translation", True)):
        p = p.withField(name, F.lit(value))
    return jobs.withColumn("provenance", p)


def yaml_scalar(value: Column) -> Column:
    special = value.rlike("[:#{}\\[\\]&*!|>'\"%@`\n]") | (trim(value) != value)
    quoted = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return F.when(value == "", '""').when(special, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(value)


def yaml_block(p: Column, parts: Column) -> Column:
    """A provenance struct (with target_lang, model, mode, translated, machine_translation) as YAML."""

    def line(name: str, value: Column) -> Column:
        v = F.coalesce(value, F.lit(""))
        return F.when(v != "", F.concat(F.lit(f"  {name}: "), yaml_scalar(v), F.lit("\n"))).otherwise("")

    out = [F.lit(STAMP_KEY + "\n")]
    out += [line(n, p[n]) for n in ("tool", "version", "url", "source", "source_sha256")]
    chars = p["source_chars"]
    out.append(F.when(chars > 0, F.concat(F.lit("  source_chars: "), chars.cast("string"), F.lit("\n"))).otherwise(""))
    out += [line(n, p[n]) for n in ("target_lang", "model", "mode")]
    out += [line("parts", parts), line("translated", p["translated"])]
    out.append(F.when(p["machine_translation"], "  machine_translation: true\n").otherwise(""))
    return F.concat(*[F.coalesce(x, F.lit("")) for x in out])


_FRONT = r"(?s)\A---\n((?:(?!---[ \t]*(?:\n|\z))[^\n]*\n)*)---[ \t]*(?:\n(.*))?\z"


def has_front_matter(doc: Column) -> Column:
    return doc.rlike(_FRONT)


def _without_key(body: Column) -> Column:
    """Front matter without the stamp's key and what is indented (or blank) below it."""
    state = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        inner = acc["skip"] & ((x == "") | x.startswith(" ") | x.startswith("\t"))
        skip = inner | x.startswith(STAMP_KEY)
        kept = F.when(skip, acc["kept"]).otherwise(F.array_append(acc["kept"], x))
        return F.struct(skip.alias("skip"), kept.alias("kept"))

    kept = F.aggregate(F.split(body, "\n", -1), state, step, lambda acc: acc["kept"])
    out = F.regexp_replace(F.array_join(kept, "\n"), r"\n+\z", "")
    return F.when(out == "", "").otherwise(F.concat(out, F.lit("\n")))


def stamp(doc: Column, block: Column) -> Column:
    """The document with the block in its front matter: made, or edited in place."""
    body, rest = F.regexp_extract(doc, _FRONT, 1), F.coalesce(F.regexp_extract(doc, _FRONT, 2), F.lit(""))
    made = F.concat(F.lit("---\n"), block, F.lit("---\n\n"), F.regexp_replace(doc, r"\A\n+", ""))
    edited = F.concat(F.lit("---\n"), _without_key(body), block, F.lit("---\n"), rest)
    return F.when(has_front_matter(doc), edited).otherwise(made)


def unstamp(doc: Column) -> Column:
    body, rest = F.regexp_extract(doc, _FRONT, 1), F.coalesce(F.regexp_extract(doc, _FRONT, 2), F.lit(""))
    left = _without_key(body)
    bare = F.regexp_replace(rest, r"\A\n+", "")
    kept = F.concat(F.lit("---\n"), left, F.lit("---\n"), rest)
    return F.when(~has_front_matter(doc), doc).when(left.rlike(rf"\A[{WS}]*\z"), bare).otherwise(kept)


def upsert(registry: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, the newest of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    rows = registry.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lookup(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (job_id) with what is known of each job and a status that says so if nothing is."""
    j = wanted.join(jobs, "job_id", "left")
    return j.withColumn("status", F.when(F.col("source_file").isNull(), "unknown job: split the document again").otherwise("ok"))


def get_parts(parts: DataFrame, edits: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys) with text (the edit, or else the original), edited, and error: why there is no such part."""
    group = [k for k in keys if k != "part"]
    totals = parts.groupBy(*group).agg(F.max("part").alias("__total"))
    now = with_edits(parts, edits, keys).select(*keys, F.col("current").alias("text"), "edited")
    j = wanted.join(totals, group, "left").join(now, keys, "left")
    error = F.when(F.col("__total").isNull(), "no such job").when(
        ~F.col("part").between(1, F.col("__total")), F.format_string("part %d is not between 1 and %d", "part", "__total")
    )
    return j.withColumn("error", error).drop("__total")


def put_parts(parts: DataFrame, texts: DataFrame, keys: list[str], at: str, skip_verify: bool = False) -> DataFrame:
    """``texts`` (keys, text) as edits where they may be stored: keys, source_hash, text, updated_at, stored, reasons.

    Refused are blank texts, parts that the job doesn't have, and texts whose structure differs from the
    original's (unless ``skip_verify``). Append the rows with ``stored`` to the edits.
    """
    rows = texts.select(*keys, F.col("text").alias("__text"))
    j = rows.join(parts.select(*keys, F.col("text").alias("__source")), keys, "left")
    checked = verify(j, "__source", "__text")
    blank = trim(F.coalesce("__text", F.lit(""))) == ""
    why = (
        F.when(F.col("__source").isNull(), F.array(F.lit("no such part"))).when(blank, F.array(F.lit("the text is blank")))
        .otherwise(F.when(F.lit(skip_verify), F.array().cast("array<string>")).otherwise(F.col("reasons")))
    )
    return checked.select(
        *keys, source_hash(F.col("__source")).alias("source_hash"), F.col("__text").alias("text"),
        F.lit(at).alias("updated_at"), (F.size(why) == 0).alias("stored"), why.alias("reasons"),
    )


def fresh_edits(edits: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """The edits whose part still has the text that they were made from.

    After a document has changed and was split again, an edit follows its text to the part that holds it
    now (the first, if several do); edits of texts that are gone drop out. ``edits`` have source_hash.
    """
    group = [k for k in keys if k != "part"]
    now = parts.select(*group, F.col("part").alias("__part"), source_hash(F.col("text")).alias("source_hash"))
    now = now.groupBy(*group, "source_hash").agg(F.min("__part").alias("__part"))
    moved = edits.join(now, [*group, "source_hash"], "inner").drop("part").withColumnRenamed("__part", "part")
    return moved.select(*edits.columns)


def merge_stamped(parts: DataFrame, edits: DataFrame, docs: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Merged documents with their stamps: group keys, file, merged, n_edited, n_parts, verdict.

    jobs: as from :func:`manifests` (and :func:`record_run`); the stamp tells how many parts are edited.
    """
    group = [k for k in keys if k != "part"]
    m = merge_job(parts, edits, docs, keys).join(jobs.select(*group, "source_file", "target", "provenance"), group)
    p, none = F.col("provenance"), F.lit(None).cast("string")
    names = set(jobs.schema["provenance"].dataType.names)
    for name, value in (("target_lang", none), ("model", none), ("mode", none), ("translated", none), ("machine_translation", F.lit(False))):
        if name not in names:
            p = p.withField(name, value)
    done = F.format_string("%d/%d", "n_edited", "n_parts")
    return m.select(*group, merged_file(F.col("source_file"), F.col("target")).alias("file"),
                    stamp(F.col("merged"), yaml_block(p, done)).alias("merged"), "n_edited", "n_parts", "verdict")
