"""Blocks, parts, outlines, merge, verification, jobs, glossary, masking and transforms on authored cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docgrain.functions import spans, text as tx
from docgrain.operators import blocks, fragments, glossary, jobs, merge, outline, parts
from docgrain.plans import requests, transform
from docgrain.sources import endpoint, files
from docgrain.streaming import ingest

MANUAL = """intro line

# Guide

Text of the guide.

## Setup

Run `make all` now.

```sh
# not a heading
make
```

### Notes

- one
- two

  more of two

## Setup

| a | b |
| - | - |
| 1 | 2 |

# Guide

The end.
"""


def shape(text):
    return [(b["kind"], b["level"], b["gap"], b["text"]) for b in blocks.parse(text)]


@pytest.mark.parametrize(
    "md, expected",
    [
        ("", []), (" \n\t\n", []), ("a\nb\n\n\nc", [("prose", 0, 2, "a\nb"), ("prose", 0, 0, "c")]),
        ("```js x=1\na\n\n```\nb", [("code", 0, 0, "```js x=1\na\n\n```"), ("prose", 0, 0, "b")]),
        ("````\n```\n````", [("code", 0, 0, "````\n```\n````")]), ("~~~\n```\n~~~~ \n", [("code", 0, 0, "~~~\n```\n~~~~ ")]),
        ("``` a`b\nx", [("prose", 0, 0, "``` a`b\nx")]), ("```\nx\n\n", [("code", 0, 0, "```\nx\n")]),
        ("# a\n## b\ntext\n#c", [("heading", 1, 0, "# a"), ("heading", 2, 0, "## b"), ("prose", 0, 0, "text\n#c")]),
        ("| a |\n|-|\ntext", [("table", 0, 0, "| a |\n|-|"), ("prose", 0, 0, "text")]),
        ("- a\nlazy\n\n  more\n\n- b", [("list", 0, 1, "- a\nlazy\n\n  more"), ("list", 0, 0, "- b")]),
        ("- a\n  ```\n\n  # x\n  ```\n  b", [("list", 0, 0, "- a\n  ```\n\n  # x\n  ```\n  b")]),
        ("1) a\n# h", [("list", 0, 0, "1) a"), ("heading", 1, 0, "# h")]), ("---\na: b\n---", [("prose", 0, 0, "---\na: b\n---")]),
        ("<div>\na\n\nb\n</div>\nc", [("html", 0, 0, "<div>\na\n\nb\n</div>"), ("prose", 0, 0, "c")]),
        ("<div>\na\n\n# h", [("html", 0, 1, "<div>\na"), ("heading", 1, 0, "# h")]),
        ("<div>\na\n\n\nb", [("html", 0, 2, "<div>\na"), ("prose", 0, 0, "b")]),
        ("<pre>\n# x\n</pre>", [("html", 0, 0, "<pre>\n# x\n</pre>")]), ("<p>one</p>\n<span>x", [("prose", 0, 0, "<p>one</p>\n<span>x")]),
        ("| a |\r\n| b |\r", [("prose", 0, 0, "| a |\r\n| b |\r")]), ("\n\n  x", [("prose", 0, 0, "  x")]), ("`<div>` is a tag", [("prose", 0, 0, "`<div>` is a tag")]),
    ],
)
def test_blocks(md, expected):
    assert shape(md) == expected


PIECES = ["# h", "## h", "text", "more text  ", "- item", "  cont", "", "", "```", "~~~ x", "| a | b |", "<div>", "</div>", "<pre>", "* * *", "1. x", " \t", "\tcode", "---", "`a` <br>"]


def corpus(seed, n, size=24):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, size))) + rng.choice(["", "\n"]) for _ in range(n)]


def canonical(text):
    rows = ["" if not r.strip(blocks.SPACE) else r for r in text.split("\n")]
    body = "\n".join(rows).strip("\n")
    return body + "\n" if body else ""


def test_parts_join_to_the_canonical_text(spark):
    texts = corpus(1, 1200) + [MANUAL]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    forms = {r.doc_id: r for r in docs.select("doc_id", tx.canonical(F.col("text")).alias("c"), tx.normalized(F.col("text")).alias("n")).collect()}
    assert all(forms[i].c == canonical(t) for i, t in enumerate(texts))
    assert forms[len(texts) - 1].n == MANUAL and all(re.search(r"\n\n\n|[ \t\r]\n", forms[i].n) is None for i in forms)
    for size in (0, 40, 200, 8000):
        rows = parts.split(docs, size)
        merged = {r.doc_id: r.text for r in merge.merge(rows, ["doc_id"]).collect()}
        # an unclosed fence may end in blank lines, which its part keeps and the canonical form does not
        assert all(merged.get(i, "") == canonical(t) for i, t in enumerate(texts))
        for r in rows.collect():
            assert r.oversize == (len(r.text.encode()) > max(1, size)) and 1 <= r.part <= r.n_parts
            assert (r.gap_after is None) == (r.part == r.n_parts)
            own = blocks.parse(texts[r.doc_id])
            if r.part < r.n_parts and size > 40:
                assert blocks.parse(r.text)[-1]["kind"] != "heading" or own[-1]["kind"] == "heading"


def test_groups_by_window_are_groups_in_row(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(2, 300))), "doc_id int, text string")
    parsed = blocks.with_blocks(docs)
    a = parts.group_rows(parsed, ["doc_id"]).select("doc_id", "block_from", "block_to", "size", "heading", "level", "atomic")
    b = parts.with_groups(parsed).select("doc_id", F.explode("groups").alias("g")).select("doc_id", "g.*")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_fill_prefers_sections():
    g = lambda n, heading=False, level=0: (0, 0, n, heading, level, False)
    assert parts.fill([], 10) == [] and parts.fill([g(99)], 10) == [(0, 1)]
    assert parts.fill([g(30), g(10, True, 1), g(60)], 100) == [(0, 1), (1, 3)]
    assert parts.fill([g(20), g(10, True, 1), g(60)], 100) == [(0, 3)]
    assert parts.fill([g(40), g(10, True, 3), g(60)], 100) == [(0, 1), (1, 3)]  # goes back to the heading
    assert parts.fill([g(49), g(49), g(1)], 100) == [(0, 2), (2, 3)]


def test_outline_and_sections(spark):
    docs = blocks.with_blocks(spark.createDataFrame([(1, MANUAL), (2, "no headings"), (3, None)], "doc_id int, text string"))
    got = [tuple(r) for r in outline.topics(docs, ["doc_id"]).orderBy("doc_id", "block_idx").select("level", "title", "path", "line", "chars").collect()]
    assert [g[:4] for g in got] == [
        (1, "Guide", "Guide", 3), (2, "Setup", "Guide > Setup", 7), (3, "Notes", "Guide > Setup > Notes", 16),
        (2, "Setup", "Guide > Setup", 23), (1, "Guide", "Guide", 29),
    ]
    lines = MANUAL.split("\n")
    assert [g[4] for g in got] == [len("\n".join(lines[a - 1 : b]).strip("\n")) for a, b in ((3, 28), (7, 22), (16, 22), (23, 28), (29, 99))]
    ask = [(1, "guide > setup > NOTES"), (1, " notes "), (1, "Setup"), (1, "set"), (1, ""), (1, "Setup > Notes"), (2, "x"), (3, "x")]
    rows = outline.sections(docs, spark.createDataFrame(ask, "doc_id int, address string"), ["doc_id"]).collect()
    by = {(r.doc_id, r.address): r for r in rows}
    notes = "### Notes\n\n- one\n- two\n\n  more of two"
    assert by[1, ask[0][1]].text == by[1, " notes "].text == notes and by[1, " notes "].status == "found"
    assert by[1, "Setup"].status == "ambiguous" and by[1, "Setup"].candidates == ["Guide > Setup"] * 2
    assert by[1, "set"].status == "missing" and by[1, "set"].candidates == ["Guide > Setup"] * 2
    assert [by[k].candidates for k in ((1, ""), (1, "Setup > Notes"), (2, "x"), (3, "x"))] == [[]] * 4


def test_verify(spark):
    cases = [
        (MANUAL, []), (MANUAL.replace("make\n", "cmake\n"), ["at block 6: the code isn't the same any more"]),
        (MANUAL.replace("### Notes", "#### Notes"), ["at block 7: heading level 3 expected, 4 found"]),
        (MANUAL.replace("| 1 | 2 |\n", ""), ["at block 10: table of 3 rows expected, 2 found"]), (MANUAL.replace("The end.", "Das Ende."), []),
        (MANUAL.replace("The end.\n", ""), ["expected 12 blocks but got 11"]),
        (MANUAL.replace("intro line", "- intro line"), ["at block 1: prose expected, list found"]),
    ]
    df = spark.createDataFrame([(i, MANUAL, x) for i, (x, _) in enumerate(cases)], "i int, source string, rewritten string")
    assert [r.reasons for r in merge.verify(df).orderBy("i").collect()] == [want for _, want in cases]


def column(spark, rows, schema, *cols):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_line_predicates(spark):
    rows = [("```go",), ("``` a`b",), ("   ~~~~",), ("# x",), ("    # x",), ("#x",), ("| a |",), ("- x",), ("* * *",), ("---",), ("  x",), ("<div>",), ("<p>x</p>",), (" \t",)]
    c = F.col("t")
    got = column(spark, rows, "t string", tx.fence_marker(c), tx.heading_level(c), tx.is_table_row(c), tx.is_list_item(c), tx.is_indented(c), tx.opens_html(c), tx.is_blank(c))
    assert [g[0] for g in got][:3] == ["```", "", "~~~~"] and [g[1] for g in got][3:6] == [1, 0, 0]
    assert got[6][2] and got[7][3] and got[8][3] and not got[9][3] and got[10][4] and got[11][5] and not got[12][5] and got[13][6]
    closing = [("```", "```", True), ("``", "```", False), ("````  ", "```", True), ("```x", "```", False), ("~~~", "```", False), ("  ```", "```", True), ("", "```", False)]
    assert column(spark, closing, "t string, m string, w boolean", tx.closes_fence(c, F.col("m"))) == [(w,) for *_, w in closing]
    assert all(blocks.closes(t, m) == w for t, m, w in closing)


@pytest.mark.parametrize("text, yes", [("-v", False), ("--out-dir", False), ("./cmd/x", False), ("os.ReadFile", False), ("1.2.0", False), ("`x`", False), ("a", False), ("two words", True), ("see `x` here", True), ("https://a.b", False), ("für", True)])
def test_translatable(spark, text, yes):
    assert fragments.is_prose(text) == yes
    assert column(spark, [(text,)], "t string", tx.is_translatable(F.col("t"))) == [(yes,)]


def test_stamp_and_yaml(spark):
    block = "translation:\n  tool: t\n"
    docs = [("# a\n",), ("---\na: 1\n---\nx\n",), ("---\ntranslation:\n  old: 1\n\n  b: 2\nc: 3\n---  \nx",), ("---\nnot closed\n",), ("---\ntranslation:\n  x: 1\n---\n\n# a\n",), ("\n\n# a",)]
    got = column(spark, docs, "d string", jobs.stamp(F.col("d"), F.lit(block)), jobs.unstamp(F.col("d")), jobs.unstamp(jobs.stamp(F.col("d"), F.lit(block))))
    assert [g[0] for g in got] == [
        "---\n" + block + "---\n\n# a\n", "---\na: 1\n" + block + "---\nx\n", "---\nc: 3\n" + block + "---\nx",
        "---\n" + block + "---\n\n---\nnot closed\n", "---\n" + block + "---\n\n# a\n", "---\n" + block + "---\n\n# a",
    ]
    assert got[0][1] == "# a\n" and got[1][1] == "---\na: 1\n---\nx\n" and got[2][1] == "---\nc: 3\n---\nx" and got[4][1] == "# a\n"
    assert got[0][2] == "# a\n" and got[1][2] == "---\na: 1\n---\nx\n"
    values = [("plain", "plain"), ("", '""'), ("a: b", '"a: b"'), (' x"\\', '" x\\"\\\\"'), ("a\nb", '"a b"')]
    assert column(spark, values, "v string, w string", jobs.yaml_scalar(F.col("v"))) == [(w,) for _, w in values]


def test_jobs_files_and_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "man.md").write_bytes(MANUAL.replace("\n", "\r\n", 1).encode())
    docs = files.read_documents(spark, str(tmp_path / "in"))
    assert docs.first().text == MANUAL.replace("\n", "\r\n", 1)
    rows = parts.split(docs, 120, ["path"])
    m = jobs.manifests(rows, docs, 120, "path")
    first = m.first()
    assert first.total_parts == rows.count() and len(first.gaps) == first.total_parts - 1 and first.parts[0].file == "man-part-01.md"
    assert "guide" not in str(first).lower().replace("# guide", "")
    assert jobs.record_run(m, "de", "m", "block", "t").first().provenance.target_lang == "de"
    files.write_parts(rows.crossJoin(m.select("job_id")), str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == rows.count()
    files.write_manifests(m, str(tmp_path / "m"))
    old = '{"id": "x", "source_file": "s.md", "total_parts": 2, "gaps": [1], "chunks": ["a.md", "b.md"]}'
    (tmp_path / "old.json").write_text(old)
    back = files.read_manifests(spark, str(tmp_path / "old.json")).first()
    assert [(p.part, p.file) for p in back.parts] == [(1, "a.md"), (2, "b.md")]
    known = jobs.upsert(m.select("job_id", "source_file", F.lit(1).alias("at")), m.select("job_id", F.lit("new").alias("source_file"), F.lit(2).alias("at")), ["job_id"], "at")
    assert [r.source_file for r in known.collect()] == ["new"]
    asked = known.select("job_id").union(spark.createDataFrame([("nope",)], "job_id string"))
    assert {r.job_id: r.status[:7] for r in jobs.lookup(known, asked).collect()} == {first.job_id: "ok", "nope": "unknown"}
    names = column(spark, [("a/b.md", "de"), ("b.md", ""), ("", "x")], "s string, t string", jobs.merged_file(F.col("s"), F.col("t")), jobs.edited_file(F.lit("x-part-01.md"), F.col("t")))
    assert names == [("b.de.md", "x-part-01.de.md"), ("b.md.merged", "x-part-01.out.md"), ("merged.md", "x-part-01.x.md")]


def test_masks_and_pieces(spark):
    rng = random.Random(4)
    bits = ["`a`", "https://x.y/z", "[t](u)", "![i][r]", "[^1]", "<br>", "⟦ 3 ⟧", "words here", "für", "\n", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(200)] + corpus(5, 200)
    rows = column(spark, [(t,) for t in texts], "t string", spans.mask(F.col("t")), spans.tokens(F.col("t")), spans.restore(spans.mask(F.col("t")), spans.tokens(F.col("t"))))
    assert all(r[2].text == t and r[2].error is None for r, t in zip(rows, texts))
    for text in corpus(6, 400) + [MANUAL]:
        whole = canonical(text)[:-1] if blocks.parse(text) and blocks.parse(text)[-1]["kind"] != "code" else None
        got = fragments.pieces(text)
        if whole is not None:
            assert "".join(p for p, _ in got) == whole
        masked, saved = fragments.mask_part(text)
        back = re.sub(r"⟦(\d+)⟧", lambda m, saved=saved: saved[int(m[1])], masked)
        assert back == "".join(p for p, _ in got)
    masked, saved = fragments.mask_part(MANUAL)
    assert "make" not in masked and "Text of the guide." in masked and len(saved) == 2
    assert [p for p, t in fragments.pieces("| ab c | `x` |\n|---|---|\n") if t] == ["ab c"]


def upper(requests_):
    return ["⟦9⟧" if u == "Guide" else re.sub(r"[a-z]{3,}", lambda m: m[0].upper(), u) for _, u in requests_]


@pytest.mark.parametrize("batch", [True, False])
def test_transform_keeps_structure(spark, batch):
    docs = spark.createDataFrame([(1, MANUAL), (2, "Text of the guide.\n\nText of the guide.\n")], "doc_id int, text string")
    rows = parts.split(docs, 8000)
    opts = transform.Options(language="de", glossary={"guides": "Anleitung"}, batch_short=batch)
    got = {r.doc_id: r for r in transform.transform_parts(rows, ["doc_id", "part"], upper, opts).collect()}
    assert got[1].stored and "RUN `make all` NOW." in got[1].out or "Run `make all` NOW." in got[1].out
    assert ("# Guide" in got[1].out) != batch and "```sh\n# not a heading\nmake\n```" in got[1].out and got[2].reused == 1
    whole = transform.transform_parts(rows, ["doc_id", "part"], upper, transform.Options(mode="chunk")).collect()
    assert {r.doc_id: r.stored for r in whole} == {1: True, 2: True}
    for mode in ("block", "chunk"):
        silent = transform.transform_parts(rows, ["doc_id", "part"], lambda rs: [None] * len(rs), transform.Options(mode=mode, batch_short=batch))
        assert [(r.stored, r.error) for r in silent.collect()] == [(False, "no reply")] * 2
    broken = transform.transform_parts(rows, ["doc_id", "part"], lambda rs: ["# new\n\n" + u for _, u in rs], transform.Options(mode="chunk"))
    assert not any(r.stored for r in broken.collect())
    both = transform.transform_parts(rows, ["doc_id", "part"], lambda rs: ["# new\n\n" + u for _, u in rs], transform.Options(mode="chunk", skip_verify=True))
    assert all(r.stored and r.reasons for r in both.collect())


def test_glossary(spark):
    text = "Set `max_size` first. The chunk size matters, chunk size wins.\n\nA round-trip check; the round trip holds, round trip, round trip. Chunk size again (round-trip).\n\n```\nmaxChunks.size(x)\n```\n\nmerge_gaps(x): the merge gaps and merge gaps.\n\nSize, size, size."
    docs = blocks.with_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = {r.term: r for r in glossary.candidates(docs, ["doc_id"]).collect()}
    assert "chunk size" in got and got["chunk size"]["count"] == 3 and got["chunk size"].blocks == 2
    assert "merge gaps" not in got and "size" not in got and got["round trip"].example.startswith("A round-trip check")
    terms = [("key", "Wert", True), ("key", "Ein Satz.", False), ("key", "a / b", False), ("key", "x (y)", False), ("key", "a b c d e", False), ("key", "x" * 33, False)]
    assert column(spark, terms, "k string, v string, w boolean", tx.is_term(F.col("k"), F.col("v"))) == [(w,) for *_, w in terms]
    made = glossary.to_file(spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "j int, term string, value string"), ["j"], "English", "German")
    assert sorted((r.term, r.value) for r in glossary.from_file(made, ["j"]).collect()) == [("a", "b"), ("c", "d")]


def test_requests_and_config(monkeypatch):
    monkeypatch.setenv("DOCGRAIN_LLM_TOKEN", "secret")
    monkeypatch.setenv("DOCGRAIN_LLM_MODEL", "m")
    config = requests.Config.from_env()
    assert config.ready and not requests.Config().ready and "secret" not in config.describe() + repr(config)
    values = requests.field_values("s", "u {{.System}}", "", "de")
    path, body = endpoint._body(requests.Config(model="m", user_template="gemma3-translator"), values)
    assert path == "/chat/completions" and body["messages"] == [{"role": "user", "content": "Translate from English to German: u {{.System}}"}]
    path, body = endpoint._body(requests.Config(model="m", transport="completions", reasoning="low"), values)
    assert path == "/completions" and "s\n\nu {{.System}}<end_of_turn>" in body["prompt"] and "reasoning_effort" not in body
    with pytest.raises(ValueError):
        endpoint.http_translator(requests.Config())


def test_http_translator():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            user = body["messages"][1]["content"]
            reply = {"choices": [{"message": {"content": user.upper()}, "finish_reason": "length" if user == "cut" else "stop"}]}
            self.send_response(500 if user == "fail" else 200)
            self.end_headers()
            self.wfile.write(b"{" if user == "bad" else json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = endpoint.http_translator(requests.Config(model="m", url=f"http://127.0.0.1:{server.server_port}/v1"))
    got = ask([("s", x) for x in ("a", "fail", "cut", "bad", "")])
    assert got[0] == "A" and [g.kind for g in got[1:]] == ["http", "truncated", "json", "empty"] and "500" in got[1].message
    server.shutdown()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(MANUAL)
    for name in ("one", "two"):
        q = ingest.split_stream(ingest.document_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), 120)
        q.awaitTermination()
        (folder / f"{name}.md").write_text(f"# {name}\n\ntext\n")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("path").distinct().count() == 2
    assert {r.text for r in merge.merge(got, ["path"]).collect()} == {MANUAL, "# one\n\ntext\n"}


def test_every_query_has_sql_or_a_reason():
    import __spark_entry__ as e
    from docgrain import queries

    assert set(queries.QUERIES) - set(queries.SQL) == {"parse_pages"}  # held against plain code in test_write_back
    assert set(e.oracle_sql()) <= set(e.queries())


def test_progress_stream(spark, tmp_path):
    rows = [("j", 1, "x"), ("j", 1, "y"), ("j", 2, "z"), ("j", 3, " "), ("k", 1, "x")]
    spark.createDataFrame(rows, "job_id string, part int, text string").write.parquet(str(tmp_path / "e"))
    edits = spark.readStream.schema("job_id string, part int, text string").parquet(str(tmp_path / "e"))
    q = ingest.progress_stream(edits).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.job_id: r.done for r in spark.table("progress").collect()} == {"j": 2, "k": 1}
