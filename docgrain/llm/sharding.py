"""Sharding by a minimax contiguous partition of ordered atomic groups; DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_position

SHARDS = 24
#: Atomic groups: equal texts fall into one of these hash ranges. It bounds what the driver sees.
GROUPS = 1 << 16


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Ends (exclusive) of ``shards`` runs of ``sizes`` in order, the largest run as small as can be.

    The least feasible capacity is found by binary search, each try checked greedily by a walk over
    prefix sums; then the runs are cut at that capacity, but none shorter than an even share of what
    is left unless the capacity forbids, so that trailing runs aren't left empty.
    """
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    n = len(sizes)

    def feasible(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(total, total[at] + capacity) - 1
            if at == n:
                return True
        return False

    low, high = max([-(-total[-1] // shards), *sizes]), total[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    # Latest start of the last k runs that still fits: runs may be cut early as long as the rest fits.
    needed, at = [n], n
    for _ in range(shards):
        while at > 0 and total[needed[-1]] - total[at - 1] <= low:
            at -= 1
        needed.append(at)
    ends, at = [], 0
    for k in range(shards):
        left = shards - k
        even = total[at] + (total[-1] - total[at]) / left
        end = bisect_right(total, even) - 1
        if end < n and total[end + 1] - even < even - total[end]:
            end += 1
        end = min(max(end, needed[left - 1], at), bisect_right(total, total[at] + low) - 1)
        ends.append(n if left == 1 else end)
        at = end
    return ends


def group_of(text: Column, groups: int = GROUPS) -> Column:
    """The atomic group of a text: equal texts (null counts as empty) share it."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(groups)).cast("int")


def shard_plan(
    groups: list[tuple[int, int]], shards: int = SHARDS, heavy_alone: bool = False
) -> tuple[list[tuple[int, int]], list[int]]:
    """(group, shard) of groups set apart, and the last groups of the other shards.

    groups: (group, size) in ascending order, which the shards cut into runs. No group is set apart unless
    ``heavy_alone`` asks for it: a group that is heavier than an even share of what
    isn't yet placed would alone set the capacity for all; such groups stand first in the order, and
    each gets a shard of its own. The other shards share the rest in order of group number.
    """
    alone: list[tuple[int, int]] = []
    rest = sorted(groups, key=lambda x: (-x[1], x[0]))
    left = sum(s for _, s in groups)
    for g, s in rest if heavy_alone else []:
        if len(alone) + 1 >= shards or s * (shards - len(alone)) <= left:
            break
        alone.append((g, len(alone)))
        left -= s
    taken = {g for g, _ in alone}
    others = [(g, s) for g, s in groups if g not in taken]
    ends = cuts([s for _, s in others], shards - len(alone))
    return alone, [others[e - 1][0] if e else -1 for e in ends]


def shard(docs: DataFrame, shards: int = SHARDS, groups: int = GROUPS, heavy_alone: bool = False) -> DataFrame:
    """``docs`` with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    Size is the text's UTF-8 bytes (null: none) plus 8. Equal texts share a shard. The driver sees
    one sum per atomic group, at most ``groups``. A row's shard is a comparison of its group with
    the cuts, and its slot (gapless from 0 in the shard) an exact distributed position, so no text
    is shuffled unless the caller keeps it. Long texts count with all their bytes. The capacity is the least
    for these groups, in which unlike texts of a hash range go together: it is within one group's size, about
    1 / ``groups`` of all bytes, of the least for single texts. See :func:`shard_plan` for ``heavy_alone``. Rows of one doc_id get slots of their own; an empty table
    gives an empty table. Columns of ``docs`` named as the results are replaced.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop(*new).withColumn("size", (F.octet_length(text) + 8).cast("long"))
    rows = rows.withColumn("text_crc32", F.crc32(text.cast("binary"))).withColumn("__group", group_of(F.col("text"), groups))
    sums = sorted((r[0], r[1]) for r in rows.groupBy("__group").agg(F.sum("size")).collect())
    alone, lasts = shard_plan(sums, shards, heavy_alone)
    g = F.col("__group")
    place = F.lit(len(alone))
    for last in lasts[:-1]:
        place = place + F.when(g > last, 1).otherwise(0)
    for group, k in alone:
        place = F.when(g == group, F.lit(k)).otherwise(place)
    rows = rows.withColumn("law", F.lit("bytes")).withColumn("shard", place.cast("int"))
    key = F.struct("doc_id", "text_crc32", "size")
    rows = with_position(rows, ["shard"], [], key, "slot", buckets=1024)
    return rows.withColumn("grown_shard", F.lit(None).cast("int")).drop("__group")
