"""The local search of packing looks at all pairs of classes."""

import random
from collections import Counter
from itertools import combinations

from wavetide.llm import packing


def test_an_exchange_behind_many_barren_pairs_is_found():
    bins = Counter({(6000 + x,): 1 for x in range(650)}) + Counter({(9000, 400): 1, (9000, 500): 1})
    got = packing.local_search(bins, 10_000)
    assert (9000, 500, 400) in got and (9000,) in got and sum(got.values()) == sum(bins.values())


def test_an_exchange_of_the_smallest_of_many_pairs_is_found():
    big = tuple(range(130, 99, -1))
    assert packing._exchange((*big, 3, 2), (9995, 4), 10_000) == ((*big, 4), (9995, 3, 2))


def test_an_exchange_gains_most_of_all_moves_and_swaps():
    rng = random.Random(1)
    for _ in range(800):
        bins = []
        for _ in range(2):
            pieces = []
            while sum(pieces) + (x := rng.randrange(1, 20)) <= 40 and rng.random() > 0.2:
                pieces.append(x)
            bins.append(tuple(sorted(pieces, reverse=True)))
        a, b = sorted(bins, key=sum)
        gain = 0
        for give, take in ((1, 0), (0, 1), (1, 1), (2, 1), (1, 2)):
            for g in combinations(a, give):
                for t in combinations(b, take):
                    m = sum(g) - sum(t)
                    if sum(a) - m <= 40 and sum(b) + m <= 40:
                        gain = max(gain, (sum(a) - m) ** 2 + (sum(b) + m) ** 2 - sum(a) ** 2 - sum(b) ** 2)
        got = packing._exchange(a, b, 40)
        assert gain == (0 if got is None else sum(got[0]) ** 2 + sum(got[1]) ** 2 - sum(a) ** 2 - sum(b) ** 2)
        assert got is None or sorted(got[0] + got[1]) == sorted(a + b)


def fewest(pieces, capacity):
    """Bins that the pieces need, by trying all of them."""
    best = len(pieces)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= pieces[k]}.values():
            put(k + 1, [*rooms[:i], rooms[i] - pieces[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - pieces[k]])

    put(0, [])
    return best


def test_bins_come_near_the_fewest():
    rng, more, least = random.Random(2), 0, 0
    for _ in range(60):
        pieces = sorted((rng.randrange(1, 21) for _ in range(11)), reverse=True)
        got = packing.local_search(packing.best_fit_decreasing(Counter(pieces), 30), 30)
        assert sorted((x for b, n in got.items() for x in b * n), reverse=True) == pieces and all(sum(b) <= 30 for b in got)
        more, least = more + sum(got.values()), least + fewest(pieces, 30)
    assert more <= least * 1.02
