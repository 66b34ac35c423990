"""Whole-partition search: every fragment to one of k bins under size, completeness and contamination rules.

Best effort: greedy from a start (the seed where there is one), then single moves while the
objective, agreement of co-binned neighbour pairs less broken rules, improves. One group
holds one assembly; the constraints themselves are checked relationally in ``report``.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def search(contigs: dict[int, int], edges: list[tuple[int, int, int]], markers: dict[int, set[int]], k: int, start: dict[int, int] | None = None, low: int = 200_000, high: int = 20_000_000, least: int = 30, below: int = 4, forbidden: list[tuple[int, int]] = (), rounds: int = 20) -> dict[int, int]:
    """Bins 1..k for ``contigs`` (id -> length); edges (a, b, distance) count 100 - distance when co-binned."""
    near, ban = defaultdict(list), defaultdict(set)
    for a, b, d in edges:
        near[a].append((b, 100 - d))
        near[b].append((a, 100 - d))
    for a, b in forbidden:
        ban[a].add(b)
        ban[b].add(a)
    start = start or {}
    bins: dict[int, int] = {}
    size, held = Counter(), defaultdict(Counter)

    def put(c, b, sign=1):
        size[b] += sign * contigs[c]
        for m in markers.get(c, ()):
            held[b][m] += sign

    def gain(c, b):
        g = sum(w for o, w in near[c] if bins.get(o) == b)
        g -= 1000 * sum(bins.get(o) == b for o in ban[c])
        g -= 1000 * max(0, size[b] + contigs[c] - high) // max(1, high)
        g += sum(5 if held[b][m] == 0 else -20 for m in markers.get(c, ()))
        return g + (1 if size[b] < low else 0)

    for c in sorted(contigs, key=lambda c: (-contigs[c], c)):
        b = start.get(c) or max(range(1, k + 1), key=lambda b: (gain(c, b), -size[b], -b))
        bins[c] = b
        put(c, b)
    for _ in range(rounds):
        moved = False
        for c in sorted(contigs):
            old = bins[c]
            put(c, old, -1)
            del bins[c]
            new = max(range(1, k + 1), key=lambda b: (gain(c, b), b == old, -b))
            bins[c] = new
            put(c, new)
            moved |= new != old
        if not moved:
            break
    return bins
