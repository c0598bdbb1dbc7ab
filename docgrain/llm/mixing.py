"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_or_not, with_position, word_count

#: Weights of the sources in their order, repeating; most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 7
#: Size classes: exact below this, then this many per doubling.
STEPS = 64


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: what each source gives to the mix.

    The sources, in order of code points and null last, weigh as ``weights`` repeating, and share
    the total size; none gives more than ``most`` times its own, the excess going to the rest by
    weight. This filling level has a closed form over the sources sorted by limit per weight: the
    first k of them stay at their limits, where k is the least for which the level that the others
    then share lies below the next limit. One row per source; the windows run over that table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    s = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    every = Window.partitionBy()
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / F.sum("weight").over(after),
    )
    first = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.row_number().over(by_limit), "level"))
    s = s.withColumn("first", first).withColumn("shared", F.min("first").over(every)["level"])
    target = F.least(F.col("limit").cast("double"), F.col("shared") * F.col("weight"))
    return s.select("source", "source_size", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """``docs`` with size (words), source_size, target and copies: how often the mix takes the row.

    Within a source, documents stand in order of size class, and each adds target / source_size
    expected copies to a running sum that begins at one random offset in [0, 1) for the source (from
    the seed and the source's name); a document is emitted once for each integer that the sum
    crosses. So each has at most ``most`` copies, and the words taken come within about one document
    of each class boundary of the target. The order within a class is by hash of doc_id.

    Null text: size 0. Null source: a source of its own, last. Repeated rows: counted and drawn each
    by itself. A source without words has target 0 and its documents are not taken. Columns of
    ``docs`` named as the four results are replaced. An empty table gives an empty table.
    """
    new = ("size", "source_size", "target", "copies")
    rows = docs.drop(*new).withColumn("size", word_count(F.col("text")))
    length = F.length(F.bin("size"))
    drop = F.greatest(length - 7, F.lit(0))
    scale = F.element_at(F.array(*(F.lit(1 << i) for i in range(57))), drop + 1)
    step = (length * 2 * STEPS + F.floor(F.col("size") / scale)).cast("long")
    naming = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.withColumn("__class", step).withColumn("__name", naming)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.substring(key, 1, 2)
    # One pass gives both what the targets and what the positions need.
    fine = rows.groupBy("__name", "__class", bucket.alias("__bucket"))
    fine = checkpointed(fine.agg(F.count(F.lit(1)).alias("__count"), F.sum("size").alias("__size")))
    source = F.when(F.col("__name") != "", F.substr("__name", F.lit(2)))
    sizes = fine.groupBy(source.alias("source")).agg(F.sum("__size").alias("source_size"))
    goal = small_or_not(targets(sizes, weights, most).select(naming.alias("__goal"), "source_size", "target"))
    counts = fine.drop("__size")
    placed = with_position(rows, ["__name"], ["__class"], key, "__rank", bucket=bucket, counts=counts)
    joined = placed.join(goal, F.col("__name") == F.col("__goal"), "inner")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit(""))))
    offset = F.conv(F.substring(name, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    upto = F.floor(offset + (F.col("__rank") + 1) * each)
    since = F.floor(offset + F.col("__rank") * each)
    return joined.withColumn("copies", (upto - since).cast("long")).drop("__class", "__name", "__rank", "__goal")


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, all its columns as they were."""
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")}
    mixed = mix(docs.withColumnsRenamed(aside), weights, most, seed).where("copies > 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    own = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return mixed.select(*own, copies.alias("__copy")).drop("__copy")
