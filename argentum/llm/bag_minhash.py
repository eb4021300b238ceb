"""Weighted MinHash signatures of multisets from hierarchical Poisson processes.

A multiset's element of weight w owns the levels 0 .. w - 1.  Levels are grouped
into intervals that double: {0}, {1}, {2, 3}, {4 .. 7}, ...  Each pair of element
and interval drives one Poisson process whose rate is the interval's length; its
points carry a time, a register and a level, all derived from the element, the
interval and the point's number alone.  Points on levels the element does not own
are left out.  A register keeps the earliest time that falls on it, so two
multisets agree in a register with the probability of their weighted Jaccard
similarity, whatever else they hold; and a process ends as soon as its next point
is later than every register, which is after few points for a large multiset.
"""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def processes(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first level, interval length, weight) of every process of one multiset."""
    seeds, first, length, weight = [hashes], [np.zeros(len(hashes), np.int64)], [np.ones(len(hashes), np.int64)], [weights]
    low = 1
    while True:
        more = weights > low
        if not more.any():
            break
        span = max(1, low)
        seeds.append(mix(hashes[more] + np.uint64((int(_STEP) * (low + 1)) & (2**64 - 1))))
        first.append(np.full(int(more.sum()), low))
        length.append(np.full(int(more.sum()), span))
        weight.append(weights[more])
        low += span
    return tuple(map(np.concatenate, (seeds, first, length, weight)))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """Times, one row per multiset of (hashes, integer weights), none of them empty."""
    parts = [processes(h, w) for h, w in bags]
    seed, first, length, weight = (np.concatenate([p[i] for p in parts]) for i in range(4))
    owner = np.repeat(np.arange(len(bags)), [len(p[0]) for p in parts])
    times = np.full(len(bags) * registers, np.inf)
    rate = length.astype(np.float64)
    partial = first + length > weight
    now = np.zeros(len(seed))
    state = seed.copy()
    base = owner * registers
    while len(state):
        state = state + _STEP
        r = mix(state)
        now = now - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / rate
        at = base + ((r & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        if partial.any():
            level = np.full(len(state), -1, np.int64)
            p = np.flatnonzero(partial)
            unit = (mix(r[p] ^ _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            level[p] = first[p] + (unit * rate[p]).astype(np.int64)
            mine = level < weight
            np.minimum.at(times, at[mine], now[mine])
        else:
            np.minimum.at(times, at, now)
        latest = times.reshape(len(bags), registers).max(1)
        go = now < latest[owner]
        if not go.all():
            state, now, rate, base, owner, first, weight, partial = (x[go] for x in (state, now, rate, base, owner, first, weight, partial))
    return times.reshape(len(bags), registers)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets with sorted distinct hashes."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)
