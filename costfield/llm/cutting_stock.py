"""The cutting-stock problem over a histogram of lengths, by column generation.

Stock has one length, ``capacity``; a pattern says how many items of each length one piece of stock gives. The linear
program over patterns asks for the fewest pieces of stock that meet the histogram. Greedy patterns are its first columns; a knapsack
dynamic program over the duals then prices further ones, until the value is within ``GAP`` of a lower bound: the items' total
length, or what the best price still allows. All sizes depend on the capacity alone, however many items are counted.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

#: The linear program ends when at most this share above its optimum.
GAP = 1e-3
#: Patterns taken from one pricing; pricings in a row that gain next to nothing, after which the basis at hand is rounded.
PRICED, STALLED = 32, 6

Pattern = dict[int, int]


@dataclass
class Plan:
    """``uses``: (pattern, how many pieces of stock); ``left``: how many items of each length no full pattern takes."""

    uses: list[tuple[Pattern, int]]
    left: dict[int, int]


def _price(lengths: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, list[Pattern]]:
    """The dearest pattern's value, and the dearest patterns that hold each of the dearest rows."""
    worth, row_of = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.argsort(duals):  # of rows with one length, the dearest
        if duals[i] > 0:
            worth[lengths[i]], row_of[lengths[i]] = duals[i], i
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(int(lengths.min()), capacity + 1):
        values = worth[1 : c + 1] + best[c - 1 :: -1]
        k = int(values.argmax())
        best[c], last[c] = values[k], k + 1
    held = np.maximum(duals, 0) + best[capacity - lengths]
    patterns: list[Pattern] = []
    for i in np.argsort(-held)[:PRICED]:
        pattern, room = {int(i): 1}, int(capacity - lengths[i])
        while room > 0 and last[room]:
            if (j := int(row_of[last[room]])) >= 0:
                pattern[j] = pattern.get(j, 0) + 1
            room -= int(last[room])
        if pattern not in patterns:
            patterns.append(pattern)
    return float(best[capacity]), patterns


def _greedy(lengths: list[int], demand: list[float], capacity: int) -> list[Pattern]:
    """Patterns that meet the demand one after the other, each with the longest lengths that fit and are left, until one of them is used up."""
    left, rows, patterns = list(demand), list(range(len(lengths))), []
    while rows:
        sizes, room, pattern, k = [lengths[i] for i in rows], capacity, {}, len(rows)
        while room and (k := bisect_right(sizes, room, 0, k)):
            k -= 1
            i = rows[k]
            pattern[i] = int(min(room // lengths[i], max(1, left[i])))
            room -= pattern[i] * lengths[i]
        times = min(left[i] / n for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= times * n
        patterns.append(pattern)
        rows = [i for i in rows if left[i] > 1e-9]
    return patterns


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[Pattern, float]]:
    """Patterns over the rows of ``lengths`` (ascending) and how often each is used, by column generation (revised simplex)."""
    size = len(lengths)
    held: list[Pattern] = [{i: int(capacity // k)} for i, k in enumerate(lengths)]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(held)])
    used, duals, stalled = inverse @ demand, inverse.sum(axis=0), 0
    enough = float(lengths @ demand) / capacity * (1 + GAP)
    patterns = _greedy(lengths.tolist(), demand.tolist(), capacity)
    while used.sum() > enough and stalled < STALLED:
        before = used.sum()
        for pattern in patterns:
            at, n = list(pattern), np.array(list(pattern.values()), float)
            gain = duals[at] @ n - 1
            if gain <= 1e-7:
                continue
            way = inverse[:, at] @ n
            rising = np.flatnonzero(way > 1e-6)
            if not len(rising):
                continue
            ratios = used[rising] / way[rising]
            tied = rising[ratios <= ratios.min() + 1e-12]
            row = int(tied[way[tied].argmax()])  # the largest pivot among ties keeps the inverse accurate
            least = used[row] / way[row]
            used = np.maximum(used - least * way, 0)
            used[row] = least
            pivot = inverse[row] / way[row]
            some, there = np.flatnonzero(way), np.flatnonzero(pivot)
            inverse[np.ix_(some, there)] -= np.outer(way[some], pivot[there])
            inverse[row] = pivot
            duals -= gain * pivot
            held[row] = pattern
        stalled = 0 if before - used.sum() > GAP / 10 * before else stalled + 1
        value, patterns = _price(lengths, duals, capacity)
        if value <= 1 + GAP:
            break
    return [(p, float(x)) for p, x in zip(held, used, strict=True) if x > 1e-9]


def _any_of(left: dict[int, int], target: int) -> Pattern | None:
    """Items of ``left`` that sum to ``target``, or None. The sums that can be had are the bits of whole numbers."""
    mask, sums, parts = (1 << target + 1) - 1, [1], []
    for length in sorted((k for k, n in left.items() if n and k <= target), reverse=True):
        n, step = min(left[length], target // length), 1
        while n:
            take = min(step, n)
            sums.append((sums[-1] | sums[-1] << take * length) & mask)
            parts.append((length, take))
            if sums[-1] >> target & 1:
                break
            n, step = n - take, step * 2
        if sums[-1] >> target & 1:
            break
    else:
        return {} if target == 0 else None
    found: Pattern = {}
    for before, (length, count) in zip(reversed(sums[:-1]), reversed(parts), strict=True):
        if not before >> target & 1:
            found[length] = found.get(length, 0) + count
            target -= length * count
    return found


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """Full patterns for the items of ``histogram`` (length: count; 0 < length <= capacity).

    Patterns of the linear program that fill their stock are rounded down, then by falling fraction used once more where enough is left; last, for
    each longest length left, an exact sum with other lengths is looked for. What stays is ``left``: nothing of it fills a piece of stock with its longest.
    """
    left = {k: n for k, n in sorted(histogram.items()) if n > 0}
    uses: list[tuple[Pattern, int]] = []

    def use(pattern: Pattern, times: int) -> int:
        times = min(times, *(left[k] // n for k, n in pattern.items()))
        if times > 0:
            uses.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= n * times
        return times

    if capacity in left:
        use({capacity: 1}, left[capacity])
    lengths = np.array([k for k, n in left.items() if n], int)
    if len(lengths):
        found = [({int(lengths[i]): n for i, n in p.items()}, x) for p, x in fractional(lengths, np.array([left[k] for k in lengths.tolist()], float), capacity)]
        full = [(p, x) for p, x in found if sum(k * n for k, n in p.items()) == capacity]
        for pattern, x in full:
            use(pattern, int(x + 1e-6))
        for pattern, _ in sorted(full, key=lambda f: (-(f[1] % 1), sorted(f[0].items()))):
            use(pattern, 1)
        stuck: dict[int, int] = {}
        while longest := max((k for k, n in left.items() if n), default=0):
            left[longest] -= 1
            rest = _any_of(left, capacity - longest)
            left[longest] += 1
            if rest is None:
                stuck[longest], left[longest] = left[longest], 0
            else:
                use(rest | {longest: rest.get(longest, 0) + 1}, left[longest])
        left = stuck
    return Plan(uses, left)
