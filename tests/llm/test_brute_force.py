"""Operators against plain code, and on rows that repeat, clash or are missing."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import zstandard

from docgrain.llm import common, media, mixing, packing, quality_classifier, queries, simhash, tokens, toxicity
from docgrain.llm.logistic import Curve


def naive_matches(folded, terms):
    """The longest term at each beginning of a word; whole ones have to end with it."""
    out = []
    for i in range(len(folded)):
        if i and folded[i - 1].isalnum():
            continue
        best = None
        for (term, whole), weight in terms.items():
            for spelt in {"".join(x) for x in product(*["li" if c == "l" else c for c in term])}:
                end = i + len(spelt)
                if folded.startswith(spelt, i) and not (whole and folded[end : end + 1].isalnum()):
                    if best is None or (end, weight) > best:
                        best = (end, weight)
        if best:
            out.append((i, *best))
    return out


def test_matcher_by_brute_force():
    rng = random.Random(4)
    words = ["ab", "abc", "abcd", "ball", "bail", "la", "lala", "x1", "ba", "a"]
    for _ in range(200):
        terms = {(rng.choice(words), rng.random() < 0.5): float(rng.randrange(1, 4)) for _ in range(4)}
        text = toxicity.fold("".join(rng.choice([*words, " ", " ", "\n", "-", "L", "é"]) for _ in range(30)))
        assert toxicity.Matcher(toxicity.Model(terms)).matches(text) == naive_matches(text, terms)


def test_scores_of_a_batch_are_scores_of_texts(spark):
    curve = Curve((0.1,) * 5, (1.0, 2.0, 3.0, 1.0, 1.0), (-1.0, 0.5, 0.2, 0.3, -0.1, 1.0))
    model = toxicity.Model({("bad", True): 2.0, ("awf", False): 1.5}, {"not bad"}, curve)
    texts = ["so bad", "not bad at all", "awful b4d", "", None, "fine " * 5000 + "bad", "bad " * 50]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for i, t in enumerate(texts):
        weight, density, n = toxicity.Matcher(model).measure(t)
        x = [np.log1p(weight), np.log1p(density), min(weight, 12) / 4, np.log1p(n), float(weight > 0)]
        z = curve.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(curve.weights[1:], x, curve.mean, curve.scale))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))
    kept = toxicity.drop_toxic(df, model).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i in got if got[i] < 0.5)


def test_sizes_by_plain_compression():
    good, bad = b"the quick brown fox " * 50, b"zzz 1234 zzz !!! " * 50
    text = "the quick zzz brown 1234 " * 4000
    data = text.encode()
    want = []
    for d in (good, bad, b""):
        plain = {"level": quality_classifier.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        dictionary = {"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}
        step = quality_classifier.CHUNK_BYTES
        want.append(sum(len(zstandard.ZstdCompressor(**plain, **dictionary).compress(data[i : i + step])) for i in range(0, len(data), step)))
    assert quality_classifier.Sizer(good, bad).sizes(text) == (*want, len(data))
    assert quality_classifier.Sizer(good, bad).sizes(None)[3] == 0


def least_bins(sizes, capacity):
    """The least number of bins, by trying all assignments."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_packing_finds_the_optimum(seed):
    rng = random.Random(seed)
    for _ in range(6):
        capacity = rng.randrange(15, 40)
        sizes = sorted((rng.randrange(3, capacity // 2 + 3) for _ in range(11)), reverse=True)
        hist = dict(Counter(sizes))
        got = packing.solve(hist, capacity, 200_000)
        used = Counter()
        for filling, n in got:
            assert sum(s * k for s, k in filling) <= capacity
            for s, k in filling:
                used[s] += k * n
        assert used == Counter(sizes) and sum(n for _, n in got) == least_bins(sizes, capacity)


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "one text of some words here"), (1, "and another quite unlike it"), (1, "one text of some words here"),
            (2, "ONE text of some words here"), (None, "a third"), (None, "a third"), (3, None), (4, "")]
    for n in (1, 4):
        kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [
            (0, "a third"), (1, "and another quite unlike it"), (1, "one text of some words here"), (3, "")]


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 7), f"size {i}", -i, "t") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, copies int, Target string")
    copies = {r.doc_id: r.copies for r in mixing.mix(df.drop("size", "copies", "Target")).collect()}
    out = mixing.take(df)
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == Counter({r: copies[r[0]] for r in rows if copies[r[0]]})


def test_one_place_for_a_digest(spark, tmp_path):
    rows = [(i, ["same", "other", None, ""][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = media.store_payloads(df, str(tmp_path))
    places = {(r.digest, r.shard, r.offset, r.length) for r in index.collect()}
    assert index.count() == 40 and len(places) == len({p[0] for p in places}) == 3
    back = media.read_payloads(index, str(tmp_path), with_payload=True).collect()
    assert {bytes(r.payload).rstrip(b" ") for r in back} == {b"same", b"other", b""}


def test_unknown_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = str(tmp_path / "t.json")
    vocab = {"a": 0, "b": 1, " ": 2, "a b": 3, "[U]": 4}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[U]"))
    tok.pre_tokenizer = pre_tokenizers.Split("x", "removed")
    tok.save(path)
    enc = tokens.Encoder(path)
    import pyarrow as pa

    texts = ["a b", "axb", "a bxa", None]
    (_, counts, ids), = enc.blocks(pa.array(texts), True)
    assert enc.kind == "other"
    assert [x.tolist() for x in ids] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert tokens.Encoder(queries.tokenizer("byte_bpe_50k.json")).kind == "spaced"
    assert tokens.Encoder(queries.tokenizer("word_bpe_49k.json")).kind == "words"


def test_pieces_are_forgotten_without_harm(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KNOWN", 60)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 400)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(90)}." for _ in range(40)) for _ in range(60)]
    enc = tokens.Encoder(queries.tokenizer("word_bpe_49k.json"))
    for _ in range(2):
        got = [r.tolist() for _, _, rows in enc.blocks(pa.array(texts), True) for r in rows]
        assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_model_per_worker():
    made = []
    for key in ("a", "a", "b", "a"):
        common.worker_model(key, lambda k=key: made.append(k) or k)
    assert made == ["a", "b", "a"]
