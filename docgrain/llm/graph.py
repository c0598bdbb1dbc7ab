"""Connected components of a large sparse graph by alternating star contraction, and one row of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_or_not


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of ``links`` is connected with.

    Every round hangs the larger neighbours of each node, then its smaller ones, from the least node
    known to it; edges never grow in number and the rounds are few (logarithmic squared at worst).
    Least nodes are combinable minima, and the joins that spread them have one row per node on one
    side, so a hub's edges can be dealt over tasks. Ends when every node hangs from one root: edges
    and nodes of a round are only counted, never collected. Nulls and loops are ignored.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = checkpointed(links.where(F.col(a) != F.col(b)).select(big, small).distinct())
    while True:
        least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        # Large star: every larger neighbour of v hangs from the least that v knows.
        up = edges.join(least, F.col("v") == F.col("w"), "left")
        up = up.select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang from the least of these.
        least = up.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        down = up.join(least, F.col("u") == F.col("w"), "inner")
        down = down.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        new = checkpointed(down.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        total, nodes = new.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        inner = total == nodes and new.join(
            new.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi"
        ).isEmpty()
        edges = new
        if inner:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def first_of_each(docs: DataFrame, found: DataFrame, key: str, own: Column) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id.

    found: one row per row of ``docs`` with doc_id, ``key`` (what is alike in equal texts), component_id
    (the group's smallest doc_id) and root (the group's name). ``own``: the key, of a row of ``docs``.
    Only ids cross the network: rows leave by an anti join on the ids that aren't kept. Where ids are
    null or repeat, rows are told apart by id and key.
    """
    found = checkpointed(found.select(F.col("doc_id").alias("__id"), F.col(key).alias("__key"), "component_id", F.col("root").alias("__root")))
    ids = found.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"))
    odd = small_or_not(ids.where("__id is null or __n > 1").select("__id"))
    out = small_or_not(found.where("__id <> component_id").select("__id").union(odd.select("__id")).distinct())
    at = F.col("doc_id").cast("long")
    kept = docs.where(at.isNotNull()).join(out, at == F.col("__id"), "left_anti")
    if odd.isEmpty():
        return kept
    first = found.where(F.col("__id").eqNullSafe(F.col("component_id"))).join(odd.select(F.col("__id").alias("__odd")), F.col("__id").eqNullSafe(F.col("__odd")))
    first = small_or_not(first.groupBy("__root", "__id").agg(F.min("__key").alias("__key")))
    doubtful = docs.join(odd, at.eqNullSafe(F.col("__id")), "left_semi").withColumn("__own", own)
    same = at.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    rest = doubtful.join(first, same).dropDuplicates(["__root"]).select(*docs.columns)
    return kept.select(*docs.columns).unionByName(rest)
