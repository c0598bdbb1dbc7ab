"""Best-fit packing of tokenized documents into fixed-length sequences by bin completion.

Documents are encoded once (Arrow); a document longer than a sequence is cut into full pieces and a
rest. All that the choice of bins depends on is how many pieces have each length, at most
``capacity`` numbers, so the driver solves the packing on that histogram and every piece finds its
place from its length and its rank among pieces of that length. No text and no token is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, with_position
from .tokens import encoder

CAPACITY = 4096
END_ID = 1
#: Branches that the search may visit before it settles for the incumbent. It bounds time, not input. A branch
#: mostly uses up one length, so that this is over twice what the way down to a complete packing takes.
NODES = 12_000


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
    light: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ``ids`` (binary, little-endian
    unsigned 32-bit) if asked for.

    Null and empty texts give one piece that holds the end id alone. Repeated rows give pieces of
    their own, and null doc_ids stay. Other columns of ``docs`` are ignored, whatever their names. ``light``:
    with less memory for the encoder, where workers have served other stages before.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, light), np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0)
            for first, counts, rows in enc.blocks(batch.column(1), True):
                where, number, start, length, crc, data = [], [], [], [], [], []
                for i, ids in enumerate(rows):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    for p, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity]
                        where.append(first + i)
                        number.append(p)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.data))
                        if with_ids:
                            data.append(part.tobytes())
                out = [keys.take(pa.array(where, pa.int64())), pa.array(number, pa.int32())]
                out += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                if with_ids:
                    out.append(pa.array(data, pa.binary()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(out, names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


# --- the search, on counts by length ---------------------------------------------------------------

#: A solution: (filling, number of bins so filled); a filling is ((length, times), ...), descending.
Filling = tuple[tuple[int, int], ...]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound, its refinements by item size, and the
    number of items over that of the smallest ones that fit a bin."""
    items = sorted(hist.items())
    sizes = [s for s, _ in items]
    count = np.concatenate([[0], np.cumsum([c for _, c in items])]).tolist()
    volume = np.concatenate([[0], np.cumsum([s * c for s, c in items])]).tolist()
    best, room, fit = -(-volume[-1] // capacity), capacity, 0
    for size, n in items:
        fit += min(n, room // size)
        room -= size * min(n, room // size)
    best = max(best, -(-count[-1] // max(fit, 1)))
    half = bisect_left(sizes, capacity // 2 + 1)
    for k in [0, *[s for s in sizes if s <= capacity // 2]]:
        big, low = max(half, bisect_left(sizes, capacity - k + 1)), bisect_left(sizes, k)
        n1, n2 = count[-1] - count[big], count[big] - count[half]
        rest = volume[big] - volume[low]  # items of k to capacity - k
        best = max(best, n1 + n2 + max(0, -(-(rest - n2 * capacity) // capacity)))
    return best


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts: each item goes to the fullest open bin that takes it."""
    open_: dict[int, dict[Filling, int]] = {}  # room left: fillings and their numbers of bins
    rooms: list[int] = []  # sorted

    def put(room: int, filling: Filling, n: int) -> None:
        if n:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = {}
            open_[room][filling] = open_[room].get(filling, 0) + n

    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                put(capacity - per * size, ((size, per),), left // per)
                if left % per:
                    put(capacity - left % per * size, ((size, left % per),), 1)
                break
            room = rooms[at]
            filling, n = open_[room].popitem()
            if not open_[room]:
                del open_[room], rooms[at]
            per = min(room // size, left)
            full = min(n, left // per)
            put(room - per * size, (*filling, (size, per)), full)
            put(room, filling, n - full)
            left -= per * full
    return [(f, n) for fs in open_.values() for f, n in fs.items()]


def best_fit_bins(counts: dict[int, int], sizes: list[int], capacity: int) -> int:
    """The number of bins of :func:`best_fit`, without their fillings. ``sizes``: those of ``counts``, ascending."""
    half = bisect_right(sizes, capacity // 2)
    rooms = [capacity - s for s in reversed(sizes[half:])]  # sorted; items over half a bin have one each
    number = {capacity - s: counts[s] for s in sizes[half:]}
    bins = sum(number.values())

    for size in reversed(sizes[:half]):
        left, at = counts[size], bisect_left(rooms, size)
        while left:
            if at == len(rooms):
                room, per = capacity, min(capacity // size, left)
                full = left // per
                bins += full
            else:
                room = rooms[at]
                per = min(room // size, left)
                full = min(number[room], left // per)
                number[room] -= full
                if not number[room]:
                    del number[room], rooms[at]
            left -= per * full
            room -= per * size
            if room in number:
                number[room] += full
            elif room:
                i = bisect_left(rooms, room)
                rooms.insert(i, room)
                number[room] = full
                at += i <= at
            # what is left finds no room below ``at``: the bins before are too full for another item
    return bins


def completions(sizes: list[int], counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that waste at most ``most_waste``, of any number of items.
    ``sizes`` ascend.

    Least waste first, then larger items first. A filling is dominated if a remaining item fits beside
    it, or if one of its items could give way to a larger remaining one. Sums that the items from the
    least up to each size can make are kept as bit sets (subset sum, bounded by counts), so that no
    step of the enumeration leads nowhere.
    """
    sizes = [s for s in sizes[: bisect_right(sizes, room)] if counts.get(s, 0) > 0]
    within = (1 << room + 1) - 1
    reach = [1]
    for s in sizes:
        bits, left, k = reach[-1], min(counts[s], room // s), 1
        if not (within ^ bits) >> s:  # only sums below s are missing, which no further size makes
            reach += [bits] * (len(sizes) + 1 - len(reach))
            break
        while left:
            k = min(k, left)
            bits |= bits << s * k & within
            left -= k
            k *= 2
        reach.append(bits)

    taken = [0] * len(sizes)

    def fill(i: int, rest: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Items among the ``i`` least sizes that sum to ``rest``; those of larger sizes are chosen."""
        if not rest:
            if all(counts[sizes[j]] == taken[j] for j in range(bisect_right(sizes, waste))):
                yield ()
            return
        i = min(i, bisect_right(sizes, rest))
        while i and reach[i] >> rest & 1:
            i -= 1
            s = sizes[i]
            larger = range(i + 1, bisect_right(sizes, s + waste))
            if any(counts[sizes[j]] > taken[j] for j in larger):
                continue
            for k in range(min(counts[s], rest // s), 0, -1):
                if reach[i] >> rest - s * k & 1:
                    taken[i] = k
                    for more in fill(i, rest - s * k, waste):
                        yield (s,) * k + more
            taken[i] = 0

    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> room - waste & 1:
            yield from fill(len(sizes), room - waste, waste)


def solve(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Bin completion, branch and bound, on counts by length; returns fillings and how often each is used.

    The incumbent is the best-fit-decreasing packing. If it doesn't meet the lower bound, the search
    goes depth first: it fills a bin around the largest item left with each undominated completion
    in turn, and as many bins alike as the counts allow. A branch whose waste leaves no room for fewer
    bins than the incumbent's is cut; every other branch is closed by best fit, so that each can yield
    an incumbent. ``nodes`` bounds the branches, and then the incumbent stands, which may be above
    the optimum. Ties are broken by length alone: the same counts give the same packing.
    """
    best = best_fit(hist, capacity)
    bins, bound = sum(n for _, n in best), lower_bound(hist, capacity) if hist else 0
    if bins <= bound:
        return best
    total = sum(s * c for s, c in hist.items())
    # Of each level only the step and the number of branches tried are kept; the counts are restored.
    left, sizes = dict(hist), sorted(hist)
    path: list[tuple[Filling, int]] = []
    tried, waste, used = [0], 0, 0

    def branch(number: int) -> tuple[Filling, int] | None:
        """The filling of that number around the largest item left, and of how many bins; None beyond the last."""
        top = sizes[-1]
        room, spare = capacity - top, (bins - 1) * capacity - total - waste
        left[top] -= 1
        items = next(islice(completions(sizes, left, room, spare), number, None), None)
        left[top] += 1
        if items is None:
            return None
        need = Counter((top, *items))
        times = min(left[s] // k for s, k in need.items())
        if (room - sum(items)) * times > spare:  # a wasteful filling: one bin at a time keeps the choice open
            times = 1
        return tuple(sorted(need.items(), reverse=True)), times

    def lost(filling: Filling) -> int:
        return capacity - sum(s * k for s, k in filling)

    while tried and nodes > 0 and bins > bound:
        step = branch(tried[-1]) if left else None
        if step is None:
            tried.pop()
            if path:
                filling, times = path.pop()
                for s, k in filling:
                    if s not in left:
                        insort(sizes, s)
                    left[s] = left.get(s, 0) + k * times
                waste -= lost(filling) * times
                used -= times
            continue
        nodes -= 1
        tried[-1] += 1
        filling, times = step
        for s, k in filling:
            left[s] -= k * times
            if not left[s]:
                del left[s], sizes[bisect_left(sizes, s)]
        waste += lost(filling) * times
        used += times
        path.append(step)
        tried.append(0)
        n = used + best_fit_bins(left, sizes, capacity)
        if n < bins:
            best, bins = [*path, *best_fit(left, capacity)], n
    return best


def pack(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``parts`` (as from :func:`pieces`: ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Offsets are gapless from 0 in each sequence. Columns of those names are replaced. ``parts`` is
    written to the shared checkpoint folder first, for it is read twice. The histogram sent to the
    driver and the table of places sent back have rows by length: at most ``capacity`` of them.
    An empty table gives an empty table.
    """
    parts = checkpointed(parts.drop("sequence_id", "offset"))
    spark = parts.sparkSession
    hist = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    places: dict[int, list[tuple[int, int, int, int, int]]] = {s: [] for s in hist}
    rank, sequence = dict.fromkeys(hist, 0), 0
    for filling, bins in solve(hist, capacity, nodes):
        at = 0
        for size, times in filling:
            places[size].append((rank[size], rank[size] + bins * times, sequence, times, at))
            rank[size] += bins * times
            at += size * times
        sequence += bins
    table = spark.createDataFrame(
        [(s, [tuple(p) for p in ps]) for s, ps in places.items()],
        "at_length long, places array<struct<low: long, high: long, sequence: long, times: long, at: long>>",
    )
    ranked = with_position(parts, ["length"], [], F.struct("doc_id", "piece"), "rank")
    joined = ranked.join(F.broadcast(table), F.col("length") == F.col("at_length"), "inner")
    place = F.filter("places", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"]))[0]
    joined = joined.withColumn("place", place)
    step = F.col("rank") - F.col("place.low")
    return (
        joined.withColumn("sequence_id", F.col("place.sequence") + F.floor(step / F.col("place.times")).cast("long"))
        .withColumn("offset", F.col("place.at") + F.pmod(step, F.col("place.times")) * F.col("length"))
        .drop("rank", "places", "place", "at_length")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry ``ids``: sequence_id and ids (binary).

    A group is one sequence, so it holds at most ``capacity`` tokens.
    """
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    data = F.aggregate(joined, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(data.alias("ids"))


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, light: bool = False
) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    See :func:`pieces` for null, empty, long and repeated texts, and :func:`pack` for the rest.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, light=light), capacity)
