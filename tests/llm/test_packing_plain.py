"""Packing by the histogram against best-two-fit, one document at a time."""

import bisect
import random

import numpy as np
import pytest

from glyphlake.llm import packing


def plain(lengths, capacity):
    """Bins of best-two-fit over sorted lengths, piece by piece."""
    left, bins = sorted(lengths), []

    def take(limit):
        i = bisect.bisect_right(left, limit)
        return left.pop(i - 1) if i else None

    while left:
        bin_, gap = [], capacity
        while (n := take(gap)) is not None:
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            small, best = bin_[-1], (bin_[-1], None)
            room = gap + small
            for i, a in enumerate(left):
                j = bisect.bisect_right(left, room - a) - 1
                j -= j == i
                if j >= 0 and j != i and best[0] < a + left[j] <= room:
                    best = (a + left[j], (i, j))
            if best[1]:
                two = [left[k] for k in best[1]]
                for k in sorted(best[1], reverse=True):
                    left.pop(k)
                bin_[-1:] = two
                bisect.insort(left, small)
        bins.append(bin_)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_as_few_bins_as_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([32, 64, 200])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(2 + seed / 3, 1)))) for _ in range(600)]
    plan = packing.best_two_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
    assert all(sum(b) <= capacity for b, _ in plan)
    assert sorted(n for b, times in plan for _ in range(times) for n in b) == sorted(lengths)
    found, want = sum(times for _, times in plan), len(plain(lengths, capacity))
    assert -(-sum(lengths) // capacity) <= found <= want + max(1, want // 100)
