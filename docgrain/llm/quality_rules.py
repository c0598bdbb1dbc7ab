"""Quality rules: base statistics and a learned decision list; DataFrame functions only.

The statistics are array expressions on each row. The list is learned by sequential covering from
counts of labelled rows: a rule (a conjunction of threshold conditions on ratios) is grown by
information gain on two thirds of them and pruned on the other third; rows that it covers leave, and
the next rule is grown, until no rule is precise enough. The list becomes one ordered conditional
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Thresholds tried per ratio; limits of the list; least precision of a rule on either part.
STEPS, RULES, CONDITIONS, PRECISION, SUPPORT = 40, 12, 3, 0.9, 5
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "capitals", "distinct_words", "marks")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # above the threshold, or at most it
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions under which a document is bad."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows in order.

    Texts whose windows all differ are told by a distinct count; only the others sort their windows.
    """
    sorted_ = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def let(value: Column, then) -> Column:  # binds a value once
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def same(t: Column, x: Column, i: Column) -> Column:
        return F.coalesce((i > 0) & (F.get(t, i - 1)["h"] == x["h"]), F.lit(False))

    def twice(t: Column) -> Column:
        found = F.filter(t, lambda x, i: same(t, x, i) | F.coalesce(F.get(t, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    slow = let(let(sorted_, twice), covered)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(slow)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, and the ratios of FEATURES. Null and empty texts have zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = text
    for s in SYMBOLS:
        plain = F.replace(plain, F.lit(s), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*keep, text.alias("__text"), words(F.col("text")).alias("__words"), lines.alias("__lines"),
                    (F.length(text) - F.length(plain)).alias("__symbols"))
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    d = d.select("*", F.size("__words").alias("__n"), hashes.alias("__hashes"))
    each = [lambda i, k=k: F.get(F.col("__hashes"), i + k) for k in range(WINDOW)]
    last = F.col("__n") - WINDOW
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[e(i) for e in each]))
    d = d.withColumn("__windows", F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>")))
    letters = F.length(F.array_join("__words", ""))
    d = d.select(
        *keep,
        F.col("__n").cast("long").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__windows")).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        F.size(F.array_distinct("__hashes")).alias("__n_distinct"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).alias("__capitals"),
        (F.length("__text") - F.length(F.replace("__text", F.lit("!"), F.lit("")))).alias("__marks"),
    )
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbols"),
        (F.col("n_dup_lines") / F.greatest("__n_lines", F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / n).alias("repeats"),
        (F.col("__capitals") / chars).alias("capitals"),
        (F.col("__n_distinct") / n).alias("distinct_words"),
        (F.col("__marks") / n).alias("marks"),
    )


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list from ``labelled``: FEATURES, bad (0 or 1) and part ('grow' or 'prune').

    The driver gets quantiles and, per condition grown, counts by ratio and threshold: numbers that
    don't grow with the rows. Without rows of both classes the list is empty.
    """
    probs = [i / STEPS for i in range(STEPS + 1)]
    cuts: dict[str, list[float]] = {}
    for bad in (0, 1):
        row = labelled.where(F.col("bad") == bad).agg(
            *[F.percentile_approx(f, probs, 2000).alias(f) for f in FEATURES], F.count(F.lit(1)).alias("n")
        ).first()
        if not row["n"]:
            return []
        for f in FEATURES:
            cuts[f] = sorted({*cuts.get(f, []), *(float(v) for v in row[f])})
    # Each ratio as the number of thresholds that lie below it: from here on rows are small integers.
    def below(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: t < F.col(f))).alias(f)

    binned = [below(f) for f in FEATURES]
    rows = checkpointed(labelled.select(*binned, "bad", "part"))
    rules: list[Rule] = []
    codes: list[list[tuple[str, bool, int]]] = []

    def met(conditions: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, k in conditions:
            out = out & (F.col(f) > k if above else F.col(f) <= k)
        return out

    def count(where: Column) -> dict[tuple[str, bool, int], list[int]]:
        """For each condition: good and bad rows of the growing part, good and bad of the pruning part."""
        long = rows.where(where).select(
            "bad", "part", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in FEATURES])).alias("x")
        )
        by = long.groupBy("x.f", "x.k", "bad", "part").count().collect()
        out: dict[tuple[str, bool, int], list[int]] = {}
        for r in by:
            at = 2 * (r["part"] == "prune") + r["bad"]
            for k in range(len(cuts[r["f"]])):
                out.setdefault((r["f"], r["k"] > k, k), [0] * 4)[at] += r["count"]
        return out

    while len(rules) < RULES:
        free = F.lit(True)
        for c in codes:
            free = free & ~met(c)
        rule: list[tuple[str, bool, int]] = []
        steps: list[list[int]] = []
        while len(rule) < CONDITIONS:
            seen = count(free & met(rule))
            if not seen:
                break
            first = next(iter(seen))[0]
            all_ = [sum(v) for v in zip(*(seen[x] for x in seen if x[0] == first and x[2] == next(iter(seen))[2]))]
            if not all_[1]:
                break
            before = math.log(all_[1] / (all_[0] + all_[1]))
            gain = {
                x: v[1] * (math.log(v[1] / (v[0] + v[1])) - before) for x, v in seen.items() if v[1] >= SUPPORT
            }
            best = max(gain, key=lambda x: (gain[x], x), default=None)
            if best is None or gain[best] <= 0:
                break
            rule.append(best)
            steps.append(seen[best])
            if not seen[best][0]:
                break
        # Prune: the prefix that is most precise on rows that didn't grow it.
        worth = [(v[3] - v[2]) / (v[2] + v[3]) if v[2] + v[3] else -1.0 for v in steps]
        if not worth:
            break
        keep = max(range(len(worth)), key=lambda i: (worth[i], -i))
        good, bad = steps[keep][0] + steps[keep][2], steps[keep][1] + steps[keep][3]
        if bad < PRECISION * (good + bad) or worth[keep] < 2 * PRECISION - 1:
            break
        codes.append(rule[: keep + 1])
        rules.append(Rule(tuple(Condition(f, above, cuts[f][k]) for f, above, k in codes[-1])))
    return rules


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[Rule]:
    """A decision list from :func:`statistics` (with doc_id) and labels (1 good, 0 bad; other values
    are ignored, both values for one doc_id count as bad)."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    y = y.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((1 - F.min(label)).cast("int").alias("bad"))
    part = F.when(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(3)) == 0, "prune").otherwise("grow")
    rows = stats.where("not base_failed").join(y, F.col("doc_id").cast("long") == F.col("__id"), "inner")
    return learn(checkpointed(rows.select(*FEATURES, "bad", part.alias("part"))))


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that a document meets, null if it meets none: one ordered
    conditional expression."""
    out = F.lit(None).cast("int")
    if rules:
        out = F.when(rules[0].column(), 1)
        for i, r in enumerate(rules[1:], 2):
            out = out.when(r.column(), i)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base statistics, base_failed, rule (the number of the
    learned rule that rejects it, or null) and kept.

    A document is kept if it neither fails the base limits nor meets a rule. Null and empty texts
    have no word and fail; long texts count whole; repeated rows and null doc_ids stay; other columns are
    ignored; an empty table gives an empty table. Statistics are made once and written to the shared checkpoint folder.
    """
    stats = checkpointed(statistics(docs, ["doc_id"]))
    rules = fit(stats, labels, label)
    out = stats.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)).cast("int"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
