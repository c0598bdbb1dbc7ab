"""Bin completion with fillings of any number of pieces."""

import random
from itertools import combinations

import pytest

from docgrain.llm import packing


@pytest.mark.parametrize("seed", range(20))
def test_completions_by_brute_force(seed):
    rng = random.Random(seed)
    counts = {s: rng.randrange(1, 4) for s in rng.sample(range(3, 20), 5)}
    items, room = sorted(s for s, c in counts.items() for _ in range(c)), rng.randrange(20, 45)
    every = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room}

    def dominated(f):
        left = list(items)
        for s in f:
            left.remove(s)
        waste = room - sum(f)
        return any(s < g <= s + waste for s in (0, *f) for g in left)

    got = list(packing.completions(sorted(counts), counts, room, room))
    assert len(got) == len(set(got)) and set(got) == {f for f in every if not dominated(f)}
    assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_five_pieces_a_bin():
    rng = random.Random(1)
    hist = {}
    for _ in range(20_000):
        s = rng.randrange(700, 901)
        hist[s] = hist.get(s, 0) + 1
    got = packing.solve(hist)
    used, bins = {}, 0
    for filling, n in got:
        assert sum(s * k for s, k in filling) <= packing.CAPACITY
        bins += n
        for s, k in filling:
            used[s] = used.get(s, 0) + n * k
    start = sum(n for _, n in packing.best_fit(hist, packing.CAPACITY))
    assert used == hist and bins < start - 100


@pytest.mark.parametrize("seed", range(50))
def test_bins_of_best_fit(seed):
    rng = random.Random(seed)
    capacity, hist = rng.randrange(5, 60), {}
    for _ in range(rng.randrange(1, 80)):
        s = rng.randrange(1, capacity + 1)
        hist[s] = hist.get(s, 0) + rng.choice([1, 1, 2, 5])
    expected = sum(n for _, n in packing.best_fit(hist, capacity))
    assert packing.best_fit_bins(hist, sorted(hist), capacity) == expected


def test_way_down_ends_in_a_packing():
    """About 4,000 lengths: more branches than that to a complete packing, which meets the bound. Best fit takes a bin more."""
    rng, hist = random.Random(2), {}
    for _ in range(60_000):
        s = min(4096, int(8 * 512 ** rng.random()))
        hist[s] = hist.get(s, 0) + 1
    last = (-sum(s * c for s, c in hist.items()) - 300) % 4096
    hist[last] = hist.get(last, 0) + 1
    got = packing.solve(hist)
    bound = packing.lower_bound(hist, packing.CAPACITY)
    used = {}
    for filling, n in got:
        assert sum(s * k for s, k in filling) <= packing.CAPACITY
        for s, k in filling:
            used[s] = used.get(s, 0) + n * k
    assert used == hist and sum(n for _, n in got) == bound
    assert sum(n for _, n in packing.best_fit(hist, packing.CAPACITY)) == bound + 1
