"""Multiway number partitioning by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from bisect import insort


def partition(sizes: list[int], ways: int) -> list[list[int]]:
    """Indexes of `sizes` in `ways` subsets of near-equal sums.

    A partial partition is a list of (sum, subset) in rising order that leaves out empty subsets; its imbalance is its largest
    sum less its smallest. The two partial partitions of the largest imbalance are merged, the largest sums of one with the
    smallest of the other, until one is left.
    """
    subsets: dict[int, list[int]] = {i: [i] for i in range(len(sizes))}
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    label = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - ways
        if shared <= 0:
            merged = sorted(a + b)
        elif len(b) == 1:  # the common case: one number joins the smallest subset
            (s, x), (t, y) = a.pop(0), b[0]
            subsets[x] += subsets.pop(y)
            insort(a, (s + t, x))
            merged = a
        else:
            both = []
            for (s, x), (t, y) in zip(a[:shared], reversed(b[:shared]), strict=True):
                subsets[x] += subsets.pop(y)
                both.append((s + t, x))
            merged = sorted(both + a[shared:] + b[shared:])
        low = merged[0][0] if len(merged) == ways else 0
        label += 1
        heapq.heappush(heap, (low - merged[-1][0], label, merged))
    return list(subsets.values()) if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of `sizes` (each at most capacity) in near-equal windows; one window more whenever capacity is exceeded."""
    ways = max(1, -(-sum(sizes) // capacity))
    while sizes:
        found = partition(sizes, ways)
        if max(sum(sizes[i] for i in x) for x in found) <= capacity:
            return found
        ways += 1
    return []
