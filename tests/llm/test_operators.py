"""The ten operators against brute force, round trips and held-out labels, and on awkward tables."""

import hashlib
import re
import tarfile
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrain.llm import (
    common, graph, media, mixing, packing, quality_classifier, quality_rules, queries, records, sharding, simhash,
    token_counts, tokens, toxicity,
)

SF = "/root/testdata/sf0.01"
BYTES, WORDS = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "score", "predicted", "size", "shard", "slot", "law", "target", "copies", "source_size", "sequence_id", "offset",
    "fingerprint", "component_id", "length", "rank", "key", "count", "f", "a", "b", "y", "kept", "rule", "n_bytes", "held_out",
)
LONG = "".join(f"w{i % 977} of{i % 31},\n" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It runs away at once, as foxes do.", "en", "s1", 1),
    (2, "The quick brown fox jumps over the lazy dog. It runs away at once, as foxes do.", "en", "s2", 1),
    (2, "The quick brown fox jumps over the lazy dog. It runs away at once, as foxes do.", "en", "s2", 1),
    (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n\t ", "en", "s1", 3), (None, "no id here", None, "s3", 5),
    (None, "no id here, either", None, "s3", 5), (6, LONG, "en", "s1", 1), (7, "a b  c<|endoftext|>d <|startoftext|> é é 日本語 🙂\x01\r\n", "xx", "s9", 9),
    (8, "one two three", "en", "s1", 1), (9, "ONE two THREE", "en", "s1", 1), (10, "a b", "en", "s2", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns whose names clash with those of results."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- tokens ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_agrees_with_library(path, monkeypatch):
    rng = np.random.default_rng(5)
    alphabet = [" ", "\n", "\t", "  ", "a", "B", "ß", "é", "'s", "12", "<|endoftext|>", "$", "İ", "́", " ", "\r\n", "Σ", "中", "🙂", "\x85", ".", ","]
    made = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(made, add_special_tokens=False)]
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KNOWN", 300)  # forgets again and again
    enc = tokens.Encoder(path)
    got = [r.tolist() for k in range(0, 4000, 500) for _, _, rows in enc.blocks(pa.array(made[k : k + 500]), True) for r in rows]
    assert got == want
    counts = np.concatenate([c for _, c, _ in enc.blocks(pa.array(made), False)])
    assert counts.tolist() == [len(w) for w in want]
    monkeypatch.setattr(tokens, "CUT_CHARS", 4)
    assert [enc._whole(t) for t in made] == want


def test_token_counts(odd, empty, docs, texts):
    lib = Tokenizer.from_file(BYTES)
    for df, n in ((odd, len(ROWS)), (docs, 1000)):
        rows = token_counts.count_tokens(df, BYTES).collect()
        assert len(rows) == n
    for r in rows[::9]:
        text = texts[r.doc_id]
        assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids)
        assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 1024)
    got = Counter(r.n_tokens for r in token_counts.count_tokens(odd, BYTES).collect())
    assert got == Counter(len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS)
    assert token_counts.count_tokens(empty, BYTES).collect() == []


# --- packing --------------------------------------------------------------------------------------


def check_packed(rows, expected, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    return len(by)


def pieces_of(rows, capacity=4096):
    lib = Tokenizer.from_file(WORDS)
    out = Counter()
    for key, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            out[(key, p, a, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def test_packing(odd, empty, docs, texts):
    expected = pieces_of(texts.items())
    n = check_packed(packing.pack_documents(docs, WORDS).collect(), expected)
    bound = packing.lower_bound(dict(Counter(k[3] for k in expected.elements())), 4096)
    assert bound <= n <= bound + 1
    check_packed(packing.pack_documents(odd, WORDS).collect(), pieces_of((k, t) for k, t, *_ in ROWS))
    assert packing.pack_documents(empty, WORDS).collect() == []


def test_packed_sequences_hold_the_tokens(odd):
    parts = packing.pieces(odd.where("doc_id < 6 or doc_id = 8"), WORDS, capacity=16, with_ids=True)
    packed = packing.pack(parts, 16)
    seqs = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = seqs[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_search_beats_best_fit_and_keeps_all():
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(150):
        cap = int(rng.integers(20, 120))
        hist = Counter(rng.integers(max(1, cap // 6), cap * 2 // 3 + 1, rng.integers(1, 40)).tolist())
        got = packing.solve(dict(hist), cap)
        used = Counter()
        for filling, n in got:
            assert 0 < sum(s * k for s, k in filling) <= cap
            for s, k in filling:
                used[s] += k * n
        assert used == hist
        bins, first = sum(n for _, n in got), sum(n for _, n in packing.best_fit(dict(hist), cap))
        assert packing.lower_bound(dict(hist), cap) <= bins <= first
        better += bins < first
    assert better > 3
    assert sum(n for _, n in packing.solve({3: 10**9, 5: 10**9}, 8)) == 10**9


# --- records and media ----------------------------------------------------------------------------


def test_records(spark, odd, empty, docs, texts, tmp_path):
    lib = Tokenizer.from_file(BYTES)
    folder = str(tmp_path / "r")
    manifest = records.write_records(docs, folder, BYTES)
    rows = sorted(records.read_records(manifest, folder).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in rows:
        ids = [*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(rows) == 1000
    first = manifest.first()
    index = records.read_index(folder, first.file)
    with open(f"{folder}/{first.file}", "rb") as f:  # any order
        for k in (len(index) - 1, 0):
            key, ids = records.read_record(f, int(index[k][0]))
            assert ids.tolist() == [*lib.encode(texts[key], add_special_tokens=False).ids, 2]
    data = bytearray(open(f"{folder}/{first.file}", "rb").read())
    data[40] ^= 1
    open(f"{folder}/{first.file}", "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(manifest, folder).collect()
    folder = str(tmp_path / "o")
    got = records.read_records(records.write_records(odd, folder, BYTES), folder).collect()
    want = Counter((k, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for k, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert records.read_records(records.write_records(empty, str(tmp_path / "e"), BYTES), str(tmp_path / "e")).collect() == []


def test_media(odd, empty, tmp_path):
    folder = str(tmp_path / "m")
    index = media.store_payloads(odd, folder)
    rows = media.read_payloads(media.read_headers(index, folder), folder, with_payload=True).collect()
    assert len(rows) == len(ROWS)
    by_text = defaultdict(set)
    for r in rows:
        text = next(t or "" for k, t, *_ in ROWS if k == r.doc_id and len((t or "").encode()) == r.n_bytes)
        payload = text.encode()
        payload += b" " * (max(192, -(-len(payload) // 192) * 192) - len(payload))
        assert bytes(r.payload) == payload and r.payload_bytes == len(payload) == r.width * r.height and r.bits == 8
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        with tarfile.open(f"{folder}/{r.shard}") as tar:
            member = tar.getmember(f"{r.digest}.png")
            stored = tar.extractfile(member).read()
            assert member.offset_data == r.offset and len(stored) == r.length == r.media_bytes
            assert hashlib.sha256(stored).hexdigest() == r.media_sha256
            names = tar.getnames()
            assert len(names) == len(set(names))
        by_text[payload].add((r.payload_sha256, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.read_payloads(media.store_payloads(empty, folder), folder).collect() == []


# --- near-duplicates ------------------------------------------------------------------------------


def fingerprint(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(fps, most=2):
    """fingerprint to the least of its component, by all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= most):
            x, y = find(fps[i]), find(fps[i + 1 + int(j)])
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def check_components(rows, ids_texts):
    fps = [(k, fingerprint(t)) for k, t in ids_texts]
    root = linked([f for _, f in fps])
    least = defaultdict(list)
    for k, f in fps:
        least[root[f]].append(k)
    want = Counter((k, f"{f:016x}", min((x for x in least[root[f]] if x is not None), default=None)) for k, f in fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash(docs, odd, empty, texts, monkeypatch):
    check_components(simhash.near_duplicates(docs).collect(), texts.items())
    small = [(k, t) for k, t, *_ in ROWS]
    check_components(simhash.near_duplicates(odd).collect(), small)
    assert simhash.near_duplicates(empty).collect() == []
    monkeypatch.setattr(simhash, "FULL", 1)  # all buckets with company are taken apart
    check_components(simhash.near_duplicates(docs).collect(), texts.items())


@pytest.mark.parametrize("full", [2, 10, 48])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_links_on_dense_groups(spark, monkeypatch, full, most):
    rng = np.random.default_rng(full)
    centers = [int(rng.integers(0, 1 << 63)) for _ in range(3)]
    fps = set()
    for c in centers:
        for _ in range(250):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    monkeypatch.setattr(simhash, "FULL", full)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "f long")
    found = simhash.links(df, most)
    got = {r.node: r.root for r in graph.components(found).collect()}
    classes = defaultdict(set)
    for f, r in linked(fps, most).items():
        classes[r].add(simhash._signed(f))
    mine = defaultdict(set)
    for f in fps:
        s = simhash._signed(f)
        mine[got.get(s, s)].add(s)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_keep_first(odd, docs, texts):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    root = linked([fingerprint(t) for t in texts.values()])
    want = {}
    for k, t in sorted(texts.items(), reverse=True):
        want[root[fingerprint(t)]] = k
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())
    got = simhash.keep_first(odd)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == odd.columns and ids.count(2) == 0 and ids.count(1) == 1 and ids.count(None) == 2


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(0)
    order = rng.permutation(400)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(0, 299)] + [(1000 + i, 1001 + i) for i in range(100)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = int(min(order[:300]))
    assert all(got[int(x)] == least for x in order[:300]) and all(got[1000 + i] == 1000 for i in range(101))


# --- mixing and sharding --------------------------------------------------------------------------


def water(sizes, weights, most=3):
    total, left, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    rest = float(total)
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if rest * weights[i] / w > most * sizes[i]]
        if not over:
            for i in left:
                out[i] = rest * weights[i] / w
            return out
        for i in over:
            out[i] = float(most * sizes[i])
            left.remove(i)
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in left)
    return out


def test_mixing(docs, odd, empty, texts):
    for df in (docs, odd):
        rows = mixing.mix(df).select("doc_id", "source", "text", "size", "source_size", "target", "copies").collect()
        again = mixing.mix(df.repartition(7)).select("doc_id", "text", "copies").collect()
        assert Counter((r.doc_id, r.text, r.copies) for r in rows) == Counter((r.doc_id, r.text, r.copies) for r in again)
        size, taken, most = Counter(), Counter(), Counter()
        for r in rows:
            assert r.size == len(words(r.text)) and 0 <= r.copies <= 3
            size[r.source] += r.size
            taken[r.source] += r.size * r.copies
            most[r.source] = max(most[r.source], r.size)
        names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        want = water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
        for s, w in zip(names, want):
            got = next(r for r in rows if r.source == s)
            assert got.source_size == size[s] and got.target == pytest.approx(w)
            assert abs(taken[s] - w) <= 2 * most[s]
        out = mixing.take(df)
        assert out.columns == df.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).collect() == []


def test_cuts_are_minimax():
    rng = np.random.default_rng(2)

    def least(sizes, k):
        lo, hi = max([0, *sizes]), sum(sizes)
        while lo < hi:
            mid, runs, at = (lo + hi) // 2, 1, 0
            for s in sizes:
                runs, at = (runs + 1, s) if at + s > mid else (runs, at + s)
            lo, hi = (lo, mid) if runs <= k else (mid + 1, hi)
        return lo

    for _ in range(300):
        sizes = rng.integers(1, 40, rng.integers(0, 30)).tolist()
        k = int(rng.integers(1, 9))
        ends = sharding.cuts(sizes, k)
        assert len(ends) == k and ends == sorted(ends) and ends[-1] == len(sizes)
        runs = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
        assert max(runs) == least(sizes, k)


def test_sharding(docs, odd, empty):
    for df, shards in ((docs, 24), (odd, 3)):
        rows = sharding.shard(df, shards).select("text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
        assert len(rows) == df.count()
        slots, total, place = defaultdict(list), Counter(), {}
        for r in rows:
            data = (r.text or "").encode()
            assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data) and r.grown_shard is None and r.law == "bytes"
            assert place.setdefault(data, r.shard) == r.shard and 0 <= r.shard < shards
            slots[r.shard].append(r.slot)
            total[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if df is docs:
            assert len(total) == shards and max(total.values()) <= 1.25 * sum(total.values()) / shards
    assert sharding.shard(empty).collect() == []


def test_heavy_group_gets_a_shard_of_its_own():
    alone, ends = sharding.shard_plan([(g, 10) for g in range(100)] + [(100, 5000)], 5, heavy_alone=True)
    assert alone == [(100, 0)] and ends == [24, 49, 74, 99]
    assert sharding.shard_plan([(0, 1), (1, 9)], 2) == ([], [0, 1])


def test_positions_are_exact(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") % 5).alias("o"), (F.col("id") % 700).alias("k"))
    rows = common.with_position(df, ["g"], ["o"], F.col("k"), "p", buckets=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.g].append((r.p, r.o))
    for places in by.values():
        assert [p for p, _ in sorted(places)] == list(range(len(places)))
        assert [o for _, o in sorted(places)] == sorted(o for _, o in places)


# --- scores and rules -----------------------------------------------------------------------------


def repeats(ws, k=5):
    count = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    hit = {j for i in range(len(ws) - k + 1) if count[tuple(ws[i : i + k])] > 1 for j in range(i, i + k)}
    return len(hit)


def base(text):
    text = text or ""
    ws = words(text)
    rows = [x for x in text.split("\n") if words(x)]
    rep = repeats(ws)
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), rep,
            len(ws) < 10 or 100 * rep > 20 * len(ws))


def test_quality_rules(docs, labels, odd, empty, texts):
    rows = quality_rules.apply_rules(docs, labels).collect()
    assert len(rows) == 1000
    quality = {r.doc_id: r.quality for r in labels.collect()}
    right = Counter()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.rule is None)
        if not r.base_failed and r.doc_id in quality:
            right[quality[r.doc_id], r.kept] += 1
    assert right[1, True] >= 0.98 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.8 * (right[0, True] + right[0, False])
    got = Counter(tuple(r)[1:7] for r in quality_rules.apply_rules(odd, labels).collect())
    assert got == Counter(base(t) for _, t, *_ in ROWS)
    assert quality_rules.apply_rules(empty, labels).collect() == []
    assert all(r.rule is None for r in quality_rules.apply_rules(odd, labels.limit(0)).collect())


def test_rules_are_those_of_the_statistics(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x = rng.random(len(quality_rules.FEATURES))
        bad = int(x[0] > 0.8 or (x[1] < 0.3 and x[2] > 0.6))
        rows.append((*map(float, x), bad, "prune" if i % 3 == 0 else "grow"))
    df = spark.createDataFrame(rows, [*quality_rules.FEATURES, "bad", "part"])
    rules = quality_rules.learn(df)
    got = df.withColumn("hit", quality_rules.verdict(rules).isNotNull().cast("int"))
    assert 1 < len(rules) < 10 and got.where("hit = bad").count() > 850


def auc(scores, y):
    import pandas as pd

    n1 = y.sum()
    return (pd.Series(scores).rank().to_numpy()[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(rows, labels, label):
    y = {r.doc_id: r[label] for r in labels.collect()}
    got = [(r.score, r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    s, p, t = map(np.array, zip(*got))
    return auc(s, t), (p == t).mean()


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.96), ("op5_quality", "quality", 0.96)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.queries()[name](spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    modulus, value, cut = (5, 0, 0.5) if label == "toxic" else (4, 2, 0.7)
    for r in rows[::50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == value) and r.predicted == (r.score >= cut)
    area, right = held_out(rows, spark.read.parquet(f"{sf}/labels.parquet"), label)
    assert area > least and right > least


def test_classifiers_on_awkward_tables(odd, empty, docs, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ROWS) and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert toxicity.score(empty, model).collect() == [] and toxicity.drop_toxic(odd, model).columns == odd.columns
    plain = toxicity.fit(docs, labels.limit(0))
    assert plain.matcher().score("You are a stupid idiot and a moron.") > 0.5 > plain.matcher().score("A fine day.")
    quality = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(odd, quality).collect()
    assert len(rows) == len(ROWS) and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert quality_classifier.score(empty, quality).collect() == []
    assert quality_classifier.drop_poor(odd, quality).columns == odd.columns
    blank = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd, blank).collect()} == {0.5}


@pytest.mark.parametrize("text", ["IDIOT!", "an 1d10t", "ıdіоt", "ｉｄｉｏｔ", "id​iot", "i.e. ídíöt", "the l0ser", "1oser", "$cum? s©um no, scum"])
def test_folding_finds_disguises(text):
    model = toxicity.Model({("idiot", True): 1.0, ("loser", True): 1.0, ("scum", True): 1.0, ("réeu", False): 1.0})
    assert model.matcher().measure(text)[0] == 1 + text.count("scum")


def test_matches_keep_to_words_and_exceptions():
    model = toxicity.Model({("clown", True): 1.0, ("vequ", False): 2.0}, {"circus clown"})
    assert not toxicity.spans("clowning about, a circus clown, equvequ", model)
    assert not toxicity.spans("reeux", toxicity.Model({("réeux", False): 1.0}))
    assert [w for *_, w in toxicity.spans("a clown vequxyz", model)] == [1.0, 2.0]


def test_near_copies_are_one_family(spark):
    body = " ".join(f"word{i % 37} other{i}" for i in range(200))
    rows = [(i, body + f" tail{i}", 1) for i in range(20)] + [(50 + i, f"text{i} of{i} its{i} own{i} words{i}", 0) for i in range(5)] + [(90, "a b", 1), (91, "a b", 1)]
    got = toxicity.one_of_each_family(spark.createDataFrame(rows, "doc_id long, text string, y int")).collect()
    assert Counter(r.y for r in got)[0] == 5 and Counter(r.y for r in got)[1] <= 4 and {0, 90} <= {r.doc_id for r in got}


def test_word_counts(spark):
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice([" ", "\n", "\t", "a", "é", "\x0b", "b c", " "], rng.integers(0, 9))) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    assert [r[0] for r in df.select(common.word_count(F.col("t"))).collect()] == [len(words(t)) for t in made]
