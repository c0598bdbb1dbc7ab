"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, maps homoglyphs and accented letters to plain ones and digits or signs inside
words to the letters they stand for. The lexicon begins with a short fixed list and grows by terms
learned from labels: whole words and word beginnings that toxic documents hold far more often than
others. Learned exception phrases (a term with its neighbour) take matches back. A document's score
is a logistic function of its weighted matches, as they stand and per hundred words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, worker_model, words
from .logistic import Curve, fit_curve

#: Labelled rows of each class that a model is learned from at most, chosen by hash of the doc_id.
SAMPLE = {1: 4000, 0: 8000}
#: Lexicon terms and exception phrases kept at most, and candidates for terms that the driver sees.
TERMS, PHRASES, CANDIDATES = 2000, 2000, 40_000
#: Toxic documents of the sample that a candidate occurs in, and clean ones that an exception phrase does.
LEAST_DOCS, LEAST_PHRASES = 4, 5
#: Weight of a text's matches from which more doesn't count as more, in one of the curve's inputs.
FULL_WEIGHT = 12.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Uses of a term in one document that count in learning.
MOST_USES = 6

# A starting lexicon, and phrases in which its words are harmless.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "scum", "scumbag", "loser", "losers", "clown",
    "trash", "garbage", "pathetic", "worthless", "disgusting", "vermin", "jerk", "dumbass", "bastard", "filth",
)
EXCEPTIONS = ("trash can", "trash bin", "circus clown", "garbage collector", "garbage collection", "worthless check")
# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = (
    "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd һh ӏl ɡg ɩi ɑa αa βb εe ηn ιi κk νv οo ρp τt υu χx ωw "
    "ıi łl øo đd ħh ßs æa œo ⅼl ⅰi ⅽc ⅾd"
)
DIGITS = "0o 1i 3e 4a 5s 6g 7t 8b 9g"
SIGNS = "$s @a !i |i"


def _fold_table(accents: bool) -> dict[int, str | None]:
    """What folding puts for a character. Accents of Latin letters stay unless ``accents`` asks for plain ones."""
    table: dict[int, str | None] = {}
    for c in range(0x80, 0x2C00):
        if unicodedata.combining(chr(c)):
            table[c] = None
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
        if (accents or c >= 0x250) and plain and plain != chr(c) and plain.isascii() and plain.isalnum():
            table[c] = plain
    for c in range(0xFF01, 0xFF5F):
        table[c] = chr(c - 0xFEE0).lower()
    for zero_width in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        table[zero_width] = None
    table |= {ord(p[0]): p[1] for p in (LOOKALIKES + " " + DIGITS).split()}
    return table


_TABLES = {accents: _fold_table(accents) for accents in (False, True)}
_SIGNS = {ord(p[0]): p[1] for p in SIGNS.split()}
_IN_WORD = re.compile(r"(?<=[a-z])[$@!|]+(?=[a-z])|(?<!\S)[$@](?=[a-z])")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str, accents: bool = False) -> str:
    """The text as it is matched: lower case; look-alikes, digits, and signs in words replaced; composed,
    or without accents if asked for."""
    out = text.lower()
    if not out.isascii():
        out = unicodedata.normalize("NFC", out)
    out = out.translate(_TABLES[accents])
    if _IN_WORD.search(out):
        out = _IN_WORD.sub(lambda m: m[0].translate(_SIGNS), out)
    return out


@dataclass
class Model:
    """terms: (folded term, whole word?) to weight; exceptions: phrases that take a match back;
    curve: the logistic function of what is measured (none: a fixed one)."""

    terms: dict[tuple[str, bool], float]
    exceptions: set[str] = field(default_factory=set)
    curve: Curve | None = None

    def matcher(self) -> Matcher:
        return Matcher(self)


def _spellings(term: str) -> set[str]:
    """A term and its forms with i for l: the digit one and the bar stand for both."""
    spots = [i for i, c in enumerate(term) if c == "l"][:4]
    out = set()
    for choice in product("li", repeat=len(spots)):
        letters = list(term)
        for i, c in zip(spots, choice):
            letters[i] = c
        out.add("".join(letters))
    return out


class Matcher:
    """A model's automaton. Matches are longest per place, begin at a word's beginning, and end at
    its end where the term is a whole word."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.auto = ahocorasick.Automaton()
        known: dict[str, list[tuple[bool, float]]] = {}
        for (term, whole), weight in model.terms.items():
            for spelling in _spellings(term):
                known.setdefault(spelling, []).append((whole, weight))
        for term, kinds in known.items():
            self.auto.add_word(term, (len(term), kinds))
        if known:
            self.auto.make_automaton()
        self.any = bool(known)
        whole = {t: w for t, w in model.terms.items() if t[1] and t[0].isascii()}
        self.whole = Matcher(Model(whole, model.exceptions)) if 0 < len(whole) < len(model.terms) else self if whole else None

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of all matches in a folded text, exceptions taken out."""
        found: dict[int, tuple[int, float]] = {}
        if not self.any:
            return []
        size = len(folded)
        for last, (n, kinds) in self.auto.iter(folded):
            start = last - n + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = last + 1 == size or not folded[last + 1].isalnum()
            weight = max((w for whole, w in kinds if closed or not whole), default=None)
            if weight is not None and (start not in found or found[start][0] <= last + 1):
                found[start] = (last + 1, weight)
        out = [(s, e, w) for s, (e, w) in sorted(found.items())]
        if out and self.model.exceptions:
            out = [x for x in out if not any(p in self.model.exceptions for p in phrases(folded, x[0]))]
        return out

    def measure(self, text: str | None) -> tuple[float, float, float]:
        """Weighted matches of a text, the same per hundred words, and its words: what its score depends on.

        Whole-word terms also match with accents taken off, where that finds more.
        """
        if not text:
            return 0.0, 0.0, 0.0
        folded = fold(text)
        found = self.matches(folded)
        weight = sum(w for _, _, w in found)
        if not folded.isascii() and self.whole is not None:
            weight += max(0.0, sum(w for _, _, w in self.whole.matches(fold(text, True))) - weight)
        n = 1 + folded.count(" ") + folded.count("\n")
        return weight, 100 * weight / n, n

    def score(self, text: str | None) -> float:
        return float(scores(self.model.curve, [self.measure(text)])[0])


def squash(measures: list[tuple[float, float, float]]) -> np.ndarray:
    """What the curve sees of texts' measures, one row each."""
    weight, density, words = np.asarray(measures, float).reshape(-1, 3).T
    capped = np.minimum(weight, FULL_WEIGHT) / 4
    return np.c_[np.log1p(weight), np.log1p(density), capped, np.log1p(words), weight > 0]


def scores(curve: Curve | None, measures: list[tuple[float, float, float]]) -> np.ndarray:
    """Scores of texts by their measures; without a curve, by a fixed one."""
    x = squash(measures)
    if curve is not None:
        return curve(x)
    return 1 / (1 + np.exp(-np.clip(-2.0 + 6 * x[:, 2] + x[:, 1], -30, 30)))


def phrases(folded: str, start: int) -> list[str]:
    """The word at ``start`` with the word before it, and with the word after it, on the same line."""
    line = folded.rfind("\n", 0, start) + 1
    end = folded.find("\n", start)
    end = len(folded) if end < 0 else end
    here = _WORDS.match(folded, start, end)
    if here is None:
        return []
    before = _WORDS.findall(folded, max(line, start - 40), start)
    after = _WORDS.search(folded, here.end(), min(end, here.end() + 40))
    out = [f"{before[-1]} {here[0]}"] if before else []
    return [*out, f"{here[0]} {after[0]}"] if after else out


def is_match(column: Column, modulus: int, value: int) -> Column:
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)) == value


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` rows per class that aren't held out, chosen by hash of doc_id.

    Labels of a doc_id that has both values count as the larger; null labels and ids are ignored. The chosen
    ids are bounded by ``most``, so they are broadcast and only their texts are shuffled: of rows that
    repeat an id, the one of the least text counts. Ties of the hash go to the smaller id.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_match(F.col("doc_id"), modulus, held_out))
    y = y.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    by = F.xxhash64("__id", F.lit(5))
    some = [y.where(F.col("y") == k).orderBy(by, "__id").limit(n) for k, n in most.items()]
    chosen = some[0]
    for s in some[1:]:
        chosen = chosen.unionByName(s)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "inner")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def _shingle(seed: int):
    return lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(3)], F.lit(seed))


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, y) with one of those that agree in the least hash of their three-word
    shingles, for two hashes in turn: copies and near copies don't count as evidence of their own.

    Meant for bounded samples. Texts of fewer words stand for themselves.
    """
    w = F.transform(words(F.lower("text")), lambda x: F.xxhash64(x))
    rows = rows.withColumn("__w", w)
    for seed in (1, 2):
        some = F.sequence(F.lit(0), F.size("__w") - 3)
        shingles = F.transform(some, _shingle(seed))
        sign = F.when(F.size("__w") >= 3, F.array_min(shingles)).otherwise(F.xxhash64("text"))
        first = Window.partitionBy("y", "__sign").orderBy("doc_id", "text")
        rows = rows.withColumn("__sign", sign).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return rows.drop("__w", "__sign", "__n")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate terms, counted per task: toxic documents that hold them, and uses (at most MOST_USES per
    document) in other and in toxic documents. The row of the empty term holds totals."""
    uses: tuple[Counter, Counter] = (Counter(), Counter())
    held: Counter = Counter()
    total, docs = [0, 0], 0
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            own: Counter = Counter()
            found = Counter(_WORDS.findall(fold(text.as_py() or "")))
            for w, n in found.items():
                if 2 < len(w) < 25:
                    own[w + "$"] += n
                for k in BEGINNINGS:
                    if len(w) > k:
                        own[w[:k]] += n
            for t, n in own.items():
                uses[y][t] += min(n, MOST_USES)
            total[y] += sum(found.values())
            if y:
                held.update(own.keys())
                docs += 1
    terms = [t for t in {*uses[0], *uses[1]} if uses[1][t]] + [t for t in uses[0] if not uses[1][t]]
    cols = [pa.array([*terms, ""])]
    for counts, all_ in ((held, docs), (uses[0], total[0]), (uses[1], total[1])):
        cols.append(pa.array([counts[t] for t in terms] + [all_], pa.int64()))
    yield pa.RecordBatch.from_arrays(cols, ["term", "docs", "n0", "n1"])


def choose_terms(
    rows: list[tuple[str, int, int, int]], words: tuple[int, int], share: float = 0.1
) -> dict[tuple[str, bool], float]:
    """The lexicon from (term, toxic documents, uses elsewhere, uses in toxic documents), total words, and
    the share of toxic documents: a term needs more of these than chance would give any term.

    Terms are taken in order of their log-likelihood ratio, the longer of equals first; a term is left
    out if it begins with a chosen one or a chosen one begins with it. So each family of words is held
    by the beginning, or the whole word, that tells most.
    """
    w0, w1 = max(1, words[0]), max(1, words[1])
    base = w1 / (w0 + w1)

    def ratio(a: int, b: int) -> float:
        n = a + b
        p = b / n
        out = b * math.log(p / base) if b else 0.0
        return 2 * (out + (a * math.log((1 - p) / (1 - base)) if a else 0.0))

    def lift(a: int, b: int) -> float:
        return (b + 0.5) / w1 / ((a + 0.5) / w0)

    least = 2 * math.log(max(2, len(rows))) + 12
    few = max(4.0, (math.log(max(2, len(rows))) + 3) / -math.log(min(max(share, 1e-6), 0.5)))
    told = [(ratio(a, b), len(t), t, lift(a, b)) for t, d, a, b in rows if d >= few and lift(a, b) >= 6]
    out: dict[tuple[str, bool], float] = {}
    short: set[str] = set()
    below: set[str] = set()
    for g, _, t, up in sorted(told, reverse=True):
        word = t.rstrip("$")
        if g < least or len(out) == TERMS:
            break
        if any(word[:k] in short for k in range(2, len(word) + 1)) or (t == word and word in below):
            continue
        out[(word, t != word)] = min(4.0, math.log(up))
        below.update(word[:k] for k in range(2, len(word) + 1))
        if t == word:
            short.add(word)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0,
    most: dict[int, int] | None = None,
) -> Model:
    """A model from labelled documents outside the held-out fold (crc32 of doc_id mod ``modulus``).

    Learned from the whole texts of at most SAMPLE rows per class. Without labels it is the fixed lexicon.
    """
    rows = checkpointed(one_of_each_family(labelled(docs, labels, label, modulus, held_out, most or SAMPLE)))
    counts = rows.select("text", "y").mapInArrow(_candidates, "term string, docs long, n0 long, n1 long")
    counts = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("docs", "n0", "n1")])
    counts = counts.where(F.col("term").eqNullSafe("") | (F.col("docs") >= LEAST_DOCS))
    total = counts.where("term = ''").select("n0", "n1").first()
    n0, n1 = (total[0], total[1]) if total else (0, 0)
    telling = counts.where(F.col("term") != "").where((F.col("n1") + 0.5) * F.lit(n0) >= (F.col("n0") + 0.5) * F.lit(6 * n1))
    telling = telling.orderBy(F.desc("n1"), "n0", "term").limit(CANDIDATES)
    share = rows.agg(F.avg("y")).first()[0] or 0.1
    learned = choose_terms([tuple(r) for r in telling.collect()], (n0, n1), share)
    terms = {(w, True): 1.0 for w in LEXICON} | learned
    model = Model(terms, {fold(p) for p in EXCEPTIONS})

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            got, near = [], []
            for text in batch.column(0):
                folded = fold(text.as_py() or "")
                found = matcher.matches(folded)
                near.append(sorted({p for s, _, _ in found for p in phrases(folded, s)}))
                got.append(matcher.measure(text.as_py()))
            cols = [pa.array([list(g) for g in got], pa.list_(pa.float64()))]
            cols += [batch.column(1), pa.array(near, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["m", "y", "near"])

    fields = "m array<double>, y int, near array<string>"
    seen = checkpointed(rows.select("text", "y").mapInArrow(measures, fields))
    # A phrase that clean documents keep using is an exception, if toxic ones don't depend on it.
    near = seen.select("y", F.explode("near").alias("p")).groupBy("p")
    near = near.agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic"))
    near = near.where((F.col("clean") >= LEAST_PHRASES) & (F.col("toxic") * 4 < F.col("clean")))
    found = near.orderBy(F.desc("clean"), "p").limit(PHRASES).select("p").collect()
    if found:
        model.exceptions |= {r[0] for r in found}
        seen = rows.select("text", "y").mapInArrow(measures, fields)
    got = seen.select("m", "y").collect()
    if got:
        model.curve = fit_curve(squash([r[0] for r in got]), np.array([r[1] for r in got], float))
    return model


def _matcher(terms: tuple, exceptions: tuple) -> Matcher:
    return worker_model(("toxicity", terms, exceptions), lambda: Matcher(Model(dict(terms), set(exceptions))))


def toxicity(model: Model):
    """Column function: text to score. Null and empty texts score as texts without a match."""
    state = (tuple(sorted(model.terms.items())), tuple(sorted(model.exceptions)))
    curve = model.curve

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _matcher(*state)
        for texts in batches:
            yield pa.array(scores(curve, [matcher.measure(t.as_py()) for t in texts]), pa.float64())

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts have the score of no match; long texts are matched whole; repeated rows and null
    doc_ids stay; other columns are ignored; an empty table gives an empty one.
    """
    scored = docs.select("doc_id", toxicity(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def spans(text: str, model: Model) -> list[tuple[int, int, float]]:
    """Matches of one text, as places in the folded text, with weights."""
    return model.matcher().matches(fold(text))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, all columns as they were."""
    scored = docs.withColumn("__toxicity", toxicity(model)(F.col("text")))
    return scored.where(F.col("__toxicity") < threshold).select(*docs.columns)
