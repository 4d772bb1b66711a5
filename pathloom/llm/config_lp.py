"""The configuration linear program of bin packing, by multiplicative weights.

A configuration is how many items of each length share a bin.  The program covers the
length histogram with the fewest (fractional) bins.  Each length has a weight; a
knapsack by dynamic programming prices the best configurations under the weights, which
shrink for the lengths that these cover.  The averaged weights are nearly the program's
dual prices.  A second run starts from them and uses whole bins at once: what it covers
shrinks in weight, so that all lengths are used up at one pace, and by configurations
that the prices call (almost) best.  The last twentieth, where too few items of each
length are left for that, is packed by best fit, the longest item first, together with the items of
those bins whose configurations left most room, where that saves bins.

Everything here works on a histogram of at most ``capacity`` lengths, whatever the
number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Config = dict[int, int]
#: Shares of the program's bins, those with most room first, that are opened again for the best fit.
OPENED = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6)


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: for each room, the most weight that fits, and the item taken last (0 for a free token).

    ``weights[l]`` is that of an item of length l, 0 for none.  On ties the longest item is taken.
    """
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(weights)[::-1]
    value = weights[lengths]
    fits = len(lengths) - np.searchsorted(lengths[::-1], np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c] < len(lengths):
            total = value[fits[c] :] + best[c - lengths[fits[c] :]]
            at = int(total.argmax())
            if total[at] > best[c]:
                best[c], choice[c] = total[at], lengths[fits[c] + at]
    return best, choice


def _filled(choice: np.ndarray, first: int, room: int) -> Config:
    """The item ``first`` and the best that fits beside it."""
    out = {first: 1}
    while room > 0:
        item = int(choice[room])
        if item:
            out[item] = out.get(item, 0) + 1
            room -= item
        else:
            room -= 1
    return out


def _priced(weights: np.ndarray, best: np.ndarray, choice: np.ndarray, urgent: np.ndarray, slack: float) -> Iterator[Config]:
    """Configurations within ``slack`` of the best price that share no length, the most urgent length first."""
    capacity = len(best) - 1
    lengths = np.flatnonzero(weights)
    lengths = lengths[np.argsort(-urgent[lengths], kind="stable")]
    good = weights[lengths] + best[capacity - lengths] >= best[capacity] * (1 - slack)
    done: set[int] = set()
    for length in lengths[good].tolist():
        if length not in done:
            config = _filled(choice, length, capacity - length)
            if done.isdisjoint(config):
                done |= config.keys()
                yield config


def dual_prices(counts: np.ndarray, capacity: int, rounds: int = 150, rate: float = 2.0, step: float = 0.1, slack: float = 0.02) -> tuple[np.ndarray, float]:
    """Averaged weights, scaled so that no configuration is worth more than one bin; and the
    number of bins that they prove to be needed."""
    lengths = np.flatnonzero(counts)
    ratio = lengths / capacity
    weights, covered, total = np.zeros(capacity + 1), np.zeros(capacity + 1), np.zeros(capacity + 1)
    found, least = np.zeros(capacity + 1), 0.0
    for t in range(rounds):
        weights[lengths] = ratio * np.exp(-rate * (covered[lengths] - covered[lengths].mean()))
        best, choice = price(weights, capacity)
        total += weights / best[capacity]
        if t % 10 == 9:
            scaled = total / price(total, capacity)[0][capacity]
            bins = float(scaled @ counts)
            if bins > least:
                found, least = scaled, bins
        for config in _priced(weights, best, choice, weights, slack):
            at, times = np.array(list(config)), np.array(list(config.values()))
            covered[at] += step * float((counts[at] / times).min()) * times / counts[at]
    return found, least


def _in_stock(config: Config, left: np.ndarray, capacity: int) -> Config:
    """The configuration as far as the items last, its room filled with the longest that fit."""
    out = {a: n for a, k in config.items() if (n := min(k, int(left[a])))}
    room = capacity - sum(a * k for a, k in out.items())
    if out == config or not out:
        return out
    while room:
        fits = np.flatnonzero(left[1 : room + 1])[::-1] + 1
        item = next((a for a in fits.tolist() if out.get(a, 0) < left[a]), None)
        if item is None:
            break
        out[item] = out.get(item, 0) + 1
        room -= item
    return out


def rounded(counts: np.ndarray, capacity: int, base: np.ndarray, rate: float, slack: float, rest: float, rounds: int = 400) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """Whole bins from priced configurations until ``rest`` of all tokens is left, and what is left.

    The weights are ``base`` times a factor that falls as a length is used up.
    """
    left, size = counts.astype(np.int64).copy(), np.arange(capacity + 1)
    tokens = int(left @ size)
    out: list[tuple[Config, int]] = []
    weights, urgent = np.zeros(capacity + 1), np.zeros(capacity + 1)
    step = 0.1
    for _ in range(rounds):
        before = int(left @ size)
        if before <= rest * tokens:
            break
        lengths = np.flatnonzero(left)
        used = 1 - left[lengths] / counts[lengths]
        # A trace of the volume fills what room the prices leave.
        volume = lengths / capacity
        weights[:] = 0
        weights[lengths] = np.maximum(base[lengths], 1e-6 * volume) * np.exp(-rate * (used - used.min())) + 1e-4 * volume
        urgent[lengths] = weights[lengths] / lengths
        for config in _priced(weights, *price(weights, capacity), urgent, slack):
            config = _in_stock(config, left, capacity)
            if not config:
                continue
            most = min(int(left[a]) // k for a, k in config.items())
            times = min(most, max(1, int(step * min(counts[a] / k for a, k in config.items()))))
            for a, k in config.items():
                left[a] -= k * times
            out.append((config, times))
        placed = before - int(left @ size)
        if not placed:
            slack = 2 * slack + 0.01
        elif placed * 200 < tokens:
            step = min(1.0, step * 1.5)
    return out, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing on a histogram: each item goes to the fullest bin with room, bins alike at once."""
    rooms: dict[int, list[tuple[Config, int]]] = {}

    def put(room: int, config: Config, times: int) -> None:
        if times:
            rooms.setdefault(room, []).append((config, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = capacity // length
                put(capacity - each * length, {length: each}, left // each)
                if left % each:
                    put(capacity - left % each * length, {length: left % each}, 1)
                break
            config, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // length
            full = min(times, left // each)
            put(room - each * length, config | {length: each}, full)
            times, left = times - full, left - full * each
            if times and left:  # fewer items than the next of these bins takes
                put(room - left * length, config | {length: left}, 1)
                times, left = times - 1, 0
            put(room, config, times)
    return [x for group in rooms.values() for x in group]


def _opened(taken: list[tuple[Config, int]], left: np.ndarray, capacity: int, share: float) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """The plan without the ``share`` of its bins that have most room, and all items that are loose then."""
    loose, kept = left.copy(), []
    bins = int(share * sum(times for _, times in taken))
    for config, times in sorted(taken, key=lambda x: sum(a * k for a, k in x[0].items())):
        out = min(bins, times)
        bins -= out
        for a, k in config.items():
            loose[a] += k * out
        if times > out:
            kept.append((config, times - out))
    return kept, loose


def plan(counts: np.ndarray, capacity: int, rest: float = 0.05) -> list[tuple[Config, int]]:
    """Whole configurations that together use each length exactly ``counts[length]`` times.

    The program is rounded from its dual prices and from the volume's (a lower bound that
    is better where many items are short); the result with the fewer bins counts.
    """
    if not counts.any():
        return []
    volume = np.arange(capacity + 1) / capacity * (counts > 0)
    found, best = None, 0
    for base in (dual_prices(counts, capacity)[0], volume):
        taken, left = rounded(counts, capacity, base, 1.0, 0.01, rest)
        for share in OPENED:
            kept, again = _opened(taken, left, capacity, share)
            out = kept + best_fit(again, capacity)
            bins = sum(times for _, times in out)
            if found is None or bins < best:
                found, best = out, bins
    return found
