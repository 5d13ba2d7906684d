"""The smallest capacity of ordered sizes, the cuts under it, and the opening of ranges, against brute force."""

import itertools
import random

from calspar.llm import sharding
from pyspark.sql import functions as F


def brute(sizes, shards):
    """The least capacity of all cuts: the largest run, not counting groups that stand alone but for the least of them that must count."""
    best = None
    for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        runs = [sizes[a:b] for a, b in itertools.pairwise((0, *c, len(sizes)))]
        need = max([sum(r) for r in runs if len(r) > 1], default=0)
        best = need if best is None else min(best, need)
    return best


def test_capacity_against_brute_force():
    random.seed(4)
    for _ in range(400):
        sizes = [random.choice([1, 2, 5, 9, 40]) for _ in range(random.randint(1, 8))]
        shards = random.randint(1, 4)
        best = brute(sizes, shards)
        assert max(1, best) <= sharding.least_capacity(sizes, [True] * len(sizes), shards) <= max(1, best, sum(sizes) // shards + 1)
        ends = sharding.cut_points(sizes, shards)
        assert ends[-1] == len(sizes) and ends == sorted(ends)
        runs = [sum(sizes[a:b]) for a, b in itertools.pairwise((0, *ends))]
        classic = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1))
        assert max(runs) == classic  # the largest shard is as small as any contiguous partition has it


def test_ranges_open_to_the_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_BITS", 3)
    monkeypatch.setattr(sharding, "OPEN_BITS", 2)
    random.seed(5)
    for sizes in ([random.randint(1, 100) for _ in range(300)], [random.randint(1, 9) for _ in range(200)] + [5000], [7] * 64, [3]):
        groups = spark.createDataFrame(list(enumerate(sizes)), "k long, size long").select(F.xxhash64("k").alias("group"), "size")
        order = sorted(map(tuple, groups.collect()))
        starts = sharding.best_cuts(groups, 16)
        own = [s for _, s in order]
        runs = [0] * 16
        for g, s in order:
            runs[sum(g >= x for x in starts)] += s
        low, high = max(own), sum(own)
        while low < high:  # the plain bisection over all groups
            middle = (low + high) // 2
            n, left = 1, middle
            for s in own:
                n, left = (n, left - s) if s <= left else (n + 1, middle - s)
            low, high = (low, middle) if n <= 16 else (middle + 1, high)
        assert max(runs) == low
        if max(own) == 5000:  # all others share the other shards evenly
            assert sorted(runs)[-2] <= 1.3 * (sum(own) - 5000) / 15
