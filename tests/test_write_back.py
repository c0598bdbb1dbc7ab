"""Parts written back, refreshed and merged; replies asked for once; plain code beside the parser."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as tx
from docgrain.operators import blocks, fragments, glossary, jobs, outline, parts
from docgrain.plans import transform
from docgrain.sources import files
from docgrain.streaming import ingest

KEYS = ["doc_id", "part"]


def doc(n=6):
    return "".join(f"# Part {i}\n\nThe text of part {i} is here.\n\n" for i in range(n))


def split(spark, text, size=40):
    return parts.split(spark.createDataFrame([(1, text)], "doc_id long, text string"), size)


def test_put_parts(spark):
    rows = split(spark, doc())
    texts = {r.part: r.text for r in rows.collect()}
    new = [(1, 1, texts[1].replace("here", "there")), (1, 2, " \n"), (1, 3, "only prose"), (1, 99, "x"), (1, 4, None)]
    put = jobs.put_parts(rows, spark.createDataFrame(new, "doc_id long, part int, text string"), KEYS, "t1")
    got = {r.part: r for r in put.collect()}
    assert {k for k, r in got.items() if r.stored} == {1} and got[2].reasons == ["the text is blank"]
    assert got[99].reasons == ["no such part"] and got[3].reasons and got[4].reasons == ["the text is blank"]
    loose = jobs.put_parts(rows, spark.createDataFrame(new[2:3], "doc_id long, part int, text string"), KEYS, "t1", True)
    assert loose.first().stored
    edits = put.where("stored").select(*KEYS, "source_hash", "text", "updated_at")
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 0), (1, 99), (7, 1)], "doc_id long, part int")
    read = {(r.doc_id, r.part): r for r in jobs.get_parts(rows, edits, wanted, KEYS).collect()}
    assert read[1, 1].edited and "there" in read[1, 1].text and read[1, 2].text == texts[2] and not read[1, 2].edited
    assert read[7, 1].error == "no such job" and [read[1, k].error for k in (0, 99)] == [f"part {k} is not between 1 and {len(texts)}" for k in (0, 99)]


def test_edits_follow_their_text(spark):
    rows = split(spark, doc())
    edits = jobs.put_parts(rows, rows.select(*KEYS, F.upper("text").alias("text")), KEYS, "t1").where("stored")
    edits = edits.select(*KEYS, "source_hash", "text", "updated_at")
    changed = "# New\n\nSomething new stands first now.\n\n" + doc().replace("part 3 is", "part 3 was")
    now = split(spark, changed)
    fresh = jobs.fresh_edits(edits, now, KEYS)
    by = {r.part: r.text for r in fresh.collect()}
    for r in now.collect():
        assert by.get(r.part) == (None if "New" in r.text or "was" in r.text else r.text.upper())


def test_merge_stamped(spark):
    docs = spark.createDataFrame([(1, "/x/a.md", doc())], "doc_id long, path string, text string")
    rows = parts.split(docs, 40)
    m = jobs.record_run(jobs.manifests(rows, docs, 40, target="de"), "de", "m", "block", "2024")
    edits = rows.where("part = 1").select(*KEYS, F.replace("text", F.lit("here"), F.lit("hier")).alias("text"), F.lit(1).alias("updated_at"))
    got = jobs.merge_stamped(rows, edits, docs, m, KEYS).first()
    n = rows.count()
    assert got.file == "a.de.md" and got.n_edited == 1 and got.merged.startswith("---\ntranslation:\n  tool: docgrain\n")
    assert f"  parts: 1/{n}\n" in got.merged and got.merged.endswith(doc().replace("here", "hier", 1).rstrip("\n") + "\n")


def test_every_request_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def shout(requests):
        with open(log, "a") as f:
            f.writelines(user.replace("\n", "|") + "\n" for _, user in requests)
        if len(requests) > transform.LOT:
            raise ValueError("too many at a time")
        return [transform.Failure("http", "busy") if "part 2" in user else user.upper() for _, user in requests]

    rows = split(spark, doc().replace("# Part", "# The part"), 60)
    out = transform.transform_parts(rows, KEYS, shout, transform.Options(language="de"))
    got = {r.part: r for r in out.collect()}
    with open(log) as f:
        asked = Counter(f.read().splitlines())
    assert max(asked.values()) == 1
    failed = [r for r in got.values() if r.error is not None]
    assert failed and all((r.error_kind, r.error, r.stored) == ("http", "busy", False) for r in failed)
    edits, refused = transform.as_edits(out, KEYS, "t"), transform.rejections(out, KEYS, "t")
    assert {r.part for r in edits.collect()} == {k for k, r in got.items() if r.stored}
    assert {r.part: r.reasons for r in refused.collect()} == {k: ["busy"] for k, r in got.items() if r.error}


def test_glossary_build_and_files(spark):
    found = spark.createDataFrame([(1, 1, "code fence", 3, 7, True, 20, "A code fence."), (1, 2, "part", 2, 2, False, 5, "")],
                                  "doc_id long, rank int, term string, blocks long, count long, in_code boolean, score long, example string")

    def answer(requests):
        (system, user), = requests
        assert "German" in system and user == "- code fence: A code fence.\n- part"
        return ['Here: {"Code fence": "Codeblock", "part": "part", "other": "x"}']

    built = glossary.build(found, ["doc_id"], answer, "en", "de")
    assert [(r.term, r.value, r.note) for r in built.collect()] == [("Code fence", "Codeblock", "7 occurrences in 3 chunks, also appears in code")]
    file = glossary.to_file(built, ["doc_id"], "en", "de", "m", "2024")
    back = glossary.from_file(file, ["doc_id"]).first()
    assert (back.term, back.value, back.model, back.generated, back.note[:1]) == ("Code fence", "Codeblock", "m", "2024", "7")
    two = spark.createDataFrame([(1, "b", "y"), (1, "a", "x")], "doc_id long, term string, value string")
    assert glossary.sorted_terms(two, ["doc_id"]).first().listing == "a = x\nb = y"


def test_parts_in_buckets(spark, tmp_path):
    rows = split(spark, doc()).withColumn("job_id", F.concat(F.lit("j"), F.col("part").cast("string")))
    files.write_parts(rows, str(tmp_path / "p"), buckets=4)
    assert files.read_parts(spark, str(tmp_path / "p"), buckets=4).count() == rows.count()
    assert files.read_parts(spark, str(tmp_path / "p"), "j2", buckets=4).select("part").collect() == [(2,)]
    assert len(list((tmp_path / "p").glob("bucket=*"))) <= 4
    files.write_part_files(rows.select(F.concat("job_id", F.lit(".md")).alias("file"), "text"), str(tmp_path / "f"))
    (one,) = (tmp_path / "f" / "file=j1.md").glob("part-*")
    assert one.read_text() == rows.where("part = 1").first().text.rstrip("\n") + "\n"


def test_commands(spark, tmp_path):
    from docgrain.__main__ import main

    page, store = tmp_path / "a.md", str(tmp_path / "store")
    page.write_text(doc(20))
    run = lambda *args: main([*map(str, args)], spark).collect()
    with pytest.raises(ValueError):
        run("split", store, page, "--size", 100)
    (job,) = run("split", store, page, "--size", 200, "--target", "de")
    assert job.total_parts > 3 and run("status", store)[0].done == 0
    (first,) = run("get", store, job.job_id, 2)
    new = tmp_path / "new.md"
    new.write_text(first.text.replace("here", "hier"))
    assert run("put", store, job.job_id, 2, new)[0].stored
    new.write_text("no headings")
    (refused,) = run("put", store, job.job_id, 3, new)
    assert not refused.stored and refused.reasons
    (now,) = run("status", store)
    assert now.done == 1 and now.state == "unchanged" and "hier" in run("get", store, job.job_id, 2)[0].text
    (out,) = run("merge", store)
    assert out.file == "a.de.md" and out.n_edited == 1 and "hier" in out.merged
    page.write_text("# Before\n\n" + "A new section. " * 12 + "\n\n" + doc(20))
    run("split", store, page, "--size", 200, "--target", "de")
    assert run("status", store)[0].done == 1 and "hier" in run("merge", store)[0].merged
    assert len(run("outline", page)) == 21 and run("section", page, "part 3")[0].status == "found"
    assert run("verify", page, page)[0].reasons == []


def test_progress_is_exact(spark, tmp_path):
    schema = "job_id string, part int, text string"
    rows = [("a", p, "x") for p in range(300)] + [("a", 5, "y"), ("b", 1, " \n"), ("b", 2, "z")]
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = ingest.progress_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("done_parts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.job_id, r.done) for r in spark.table("done_parts").collect()} == {("a", 300), ("b", 1)}


def test_outline_of_many_blocks(spark):
    text = "".join(f"{'#' * (1 + i % 5)} h{i}\n\ntext {i}\n\n" for i in range(6000))
    parsed = blocks.with_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    began = time.perf_counter()
    got = outline.topics(parsed, ["doc_id"]).collect()
    assert len(got) == 6000 and time.perf_counter() - began < 30
    assert got[4].path == "h0 > h1 > h2 > h3 > h4" and got[0].end_idx == 10 and got[-1].end_idx == 12000
    assert got[0].chars == len(text[: text.index("# h5")].rstrip("\n"))


def plain_outline(rows):
    """(kind, level, gap, bytes, line, title) to topics, each by a search of its own."""
    out = []
    for i, (level, title) in enumerate((r[1], r[5]) for r in rows):
        if title is None:
            continue
        end = next((j for j in range(i + 1, len(rows)) if rows[j][5] is not None and rows[j][1] <= level), len(rows))
        path = []
        for k in range(1, level):
            above = [j for j in range(i) if rows[j][5] is not None and rows[j][1] <= k]
            if above and rows[above[-1]][1] == k:
                path.append(rows[above[-1]][5])
        chars = sum(r[3] + r[2] + 1 for r in rows[i:end]) - rows[end - 1][2] - 1
        out.append((i, end, level, title, " > ".join([*path, title]), rows[i][4], chars))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_outline_by_brute_force(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(rng.randrange(0, 30)):
        head = rng.random() < 0.5
        rows.append(("heading" if head else "prose", rng.randrange(1, 7) if head else 0, rng.randrange(0, 3), rng.randrange(1, 50), i, f"t{i}" if head else None))
    cols = list(zip(*rows)) if rows else [[]] * 6
    assert outline.headings(*(list(cols[k]) for k in (1, 2, 3, 4, 5))) == plain_outline(rows)


# --- the parser by plain code -------------------------------------------------------------------

ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])(?:\s|$)", re.A)
TAGS = "|".join(tx.BLOCK_TAGS)


def balance(line):
    line = re.sub("<!--.*?-->", "", re.sub("`+[^`]*`+", "", line))
    tags = re.findall(rf"(?i)<(/?)(?:{TAGS})((?![a-zA-Z0-9])[^>]*)>", line)
    return sum(-1 if slash else 0 if rest.endswith("/") else 1 for slash, rest in tags)


def kind_of(line):
    m = re.match(r"[ \t]*(`{3,}|~{3,})(.*)", line)
    if m and not (m[1][0] == "`" and "`" in m[2]):
        return "code"
    if re.match(" {0,3}<[a-zA-Z/]", line) and balance(line) > 0:
        return "html"
    if re.match(r" {0,3}#{1,6}(\s|$)", line):
        return "heading"
    if re.match(r"[ \t]*\|.*\|[ \t]*$", line):
        return "table"
    return "list" if ITEM.match(line) else "prose"


def fence_end(lines, i):
    mark = re.match(r"[ \t]*(`+|~+)", lines[i])[1]
    for j in range(i + 1, len(lines)):
        body = lines[j].strip()
        if len(body) >= len(mark) and not body.strip(mark[0]):
            return j + 1
    return len(lines)


def plain_blocks(text):
    """(kind, first line, text) of each block, one kind after the other, looking ahead."""
    lines = [x if x.strip() else "" for x in (text[:-1] if text.endswith("\n") else text).split("\n")]
    out, i = [], 0
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        kind, j = kind_of(lines[i]), i + 1
        if kind == "code":
            j = fence_end(lines, i)
        elif kind in ("table", "prose"):
            while j < len(lines) and lines[j] and kind_of(lines[j]) == kind:
                j += 1
        elif kind == "list":
            while True:
                k = next((k for k in range(j, len(lines)) if lines[k]), None)
                if k is None:
                    break
                what = kind_of(lines[k])
                if (k > j and (ITEM.match(lines[k]) or lines[k][0] not in " \t")) or what not in ("code", "list", "prose"):
                    break
                j = fence_end(lines, k) if what == "code" else k + 1
        elif kind == "html":
            left, raw = balance(lines[i]), "<pre" in lines[i].lower() or "<code" in lines[i].lower()
            while left > 0 and j < len(lines):
                k = j if lines[j] else j + 1
                if k == len(lines) or not lines[k] or (not raw and re.match(r" {0,3}#{1,6}(\s|$)", lines[k])):
                    break
                left, raw, j = left + balance(lines[k]), raw or "<pre" in lines[k].lower() or "<code" in lines[k].lower(), k + 1
        body = lines[i:j]
        while kind != "code" and body[-1] == "":
            body.pop()
        out.append((kind, i + 1, "\n".join(body)))
        i = j
    return out


def test_parser_by_brute_force():
    rng = random.Random(9)
    some = ["<div>", "</div>", "<p>a</p>", "# head", "text", "", "", "  more", "- item", "| a | b |", "```", "<pre>", "</pre></div>", "1. one", "<section><p>"]
    for _ in range(4000):
        text = "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 14)))
        assert [(b["kind"], b["line"], b["text"]) for b in blocks.parse(text)] == plain_blocks(text), text


def test_pages_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = blocks.with_blocks(pages, "html").collect()
    assert got and any("\n" in r.html for r in got)
    for r in got:
        want = plain_blocks(r.html.replace("\r", " ") if "\r" in r.html else r.html)
        assert [(b.kind, b.line, b.text) for b in r.blocks] == want


def test_pieces_keep_every_character():
    rng = random.Random(5)
    some = ["# A title", "text of `code` here", "| a word | `x` |", "|---|---|", "- an item", "  ```", "  code here", "  ```", "", "~~~", "1. one more", "##"]
    for _ in range(2000):
        text = "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 10)))
        whole = "".join(b["text"] + "\n" * (b["gap"] + 1) for b in blocks.parse(text))[:-1] if blocks.parse(text) else ""
        pieces = fragments.pieces(text)
        assert "".join(p for p, _ in pieces) == whole
        assert not any("`" * 3 in p for p, free in pieces if free)
        masked, saved = fragments.mask_part(text)
        assert re.sub("⟦(\\d+)⟧", lambda m: saved[int(m[1])], masked) == whole


def test_terms_lists_and_empty_parts(spark):
    text = "The chunk and `code` here.\n\nThe chunk and `code` here.\n\nAnother line, without it.\n\n" + "A longer sentence that no list may hold, as it has too many letters. " * 2
    rows = spark.createDataFrame([(1, 1, text), (1, 2, ""), (1, 3, None), (1, 4, "Only one.")], "doc_id long, part int, text string")

    def answer(requests):
        out = []
        for system, user in requests:
            if "numbered" in system:
                assert "Fixed terms" not in system and user.startswith("1. The chunk and ⟦0⟧ here.\n2. Another")
                out.append("1. Der Block und ⟦0⟧ hier.\n1. Ein ⟦0⟧.\n2. # New heading\n9. x")
            else:
                assert ("- chunks = Block" in system) == ("chunk" in user)
                out.append(user.upper())
        return out

    got = {r.part: r for r in transform.transform_parts(rows, KEYS, answer, transform.Options(language="de", glossary={"chunks": "Block"})).collect()}
    first = got[1]
    assert first.out.startswith("Ein `code`.\n\nEin `code`.\n\nANOTHER LINE") or first.out.startswith("Der Block und `code` hier.\n\nDer")
    assert (first.requests, first.accepted, first.reused, first.kept, first.stored, first.source) == (2, 1, 1, 0, True, text)
    assert [(got[i].out, got[i].stored, got[i].error, got[i].requests) for i in (2, 3)] == [(None, False, None, 0)] * 2
    assert (got[4].out, got[4].requests, got[4].accepted) == ("ONLY ONE.\n", 1, 0)
