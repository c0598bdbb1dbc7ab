"""The tail of a long text counts as much as its head."""

import random

from docgrain.llm import quality_classifier


def test_tail_moves_the_difference():
    rng = random.Random(5)
    vocabulary = {y: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4000)] for y in (0, 1)}
    text = lambda y, n: " ".join(rng.choices(vocabulary[y], k=n // 9))
    good, bad = (quality_classifier.train([text(y, 1024).encode() for _ in range(600)]) for y in (1, 0))
    sizer = quality_classifier.Sizer(good, bad)

    def difference(t):
        by_good, by_bad, _, n = sizer.sizes(t)
        assert n == len(t)
        return by_bad - by_good

    head = text(1, 400_000)
    own = difference(head)
    with_good, with_bad = difference(head + " " + text(1, 200_000)), difference(head + " " + text(0, 200_000))
    assert with_good > 1.3 * own > 0 and with_bad < 0.7 * own
    assert sizer.sizes("")[:3] == sizer.sizes(None)[:3] and sizer.sizes("")[3] == 0
