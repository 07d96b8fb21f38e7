"""BagMinHash: signatures of weighted sets whose components agree with the probability of the weighted Jaccard similarity.

The weight of an element (here, how often a shingle stands in a text) is cut at
the powers of two into intervals. On each interval, for each element, runs a
Poisson process whose rate is the interval's length; every point draws a
component of the signature and a level inside the interval, and counts if the
level lies below the weight: thinning splits the process down to the weight
without ever visiting smaller intervals. A component keeps the earliest point
that counts. Points are functions of element, interval and number alone, so two
texts see the same points wherever both weights reach. A process is followed
only until its points come later than the latest component: work grows with
the elements plus the signature, not with their product.
"""

from __future__ import annotations

import numpy as np

from socklens.llm.words import mix

_STEP = np.uint64(0xD1342543DE82EF95)
_TURN = np.uint64(0xA0761D6478BD642F)


def processes(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, rate, reach) of the interval processes: (0, 1], (1, 2], (2, 4], ... up to the weight; ``reach`` is what the weight covers of each."""
    if counts.max() == 1:
        return mix(elements), np.ones(len(elements)), np.ones(len(elements))
    seeds, rates, reaches, low, level = [], [], [], 0, 0
    while True:
        here = counts > low
        if not here.any():
            return np.concatenate(seeds), np.concatenate(rates), np.concatenate(reaches)
        length = max(low, 1)
        seeds.append(mix(elements[here] + np.uint64(level * int(_TURN) & (1 << 64) - 1)))
        rates.append(np.full(len(seeds[-1]), float(length)))
        reaches.append(np.minimum(counts[here] - low, length).astype(float))
        low, level = low + length, level + 1


def signature(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """``size`` unsigned integers for distinct elements with whole weights of one or more.

    A component is the identity of its earliest point, so equality of components
    does not hang on how a machine rounds logarithms.
    """
    seed, rate, reach = processes(elements, counts)
    time = np.full(size, np.inf)
    point = np.zeros(size, np.uint64)
    last, drawn = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    at_once = int(np.clip(np.ceil(1.3 * size * np.log(size) / rate.sum()), 1, 256))
    steps = np.arange(1, at_once + 1, dtype=np.uint64)
    going = np.arange(len(seed))
    while len(going):
        key = mix(seed[going, None] + (drawn[going, None] + steps) * _STEP)
        wait = -np.log(((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        when = last[going, None] + np.cumsum(wait / rate[going, None], axis=1)
        last[going], drawn[going] = when[:, -1], drawn[going] + np.uint64(at_once)
        choice = mix(key ^ _TURN)
        component = (choice % np.uint64(size)).astype(np.int64)
        level = (choice >> np.uint64(40)) * (2.0**-24) * rate[going, None]
        better = (level < reach[going, None]) & (when < time[component])
        when, key, component = when[better], key[better], component[better]
        order = np.argsort(-when, kind="stable")  # the earliest of a component is written last
        time[component[order]], point[component[order]] = when[order], key[order]
        going = np.flatnonzero(last < time.max())
    return point


def bands(point: np.ndarray, rows: int) -> np.ndarray:
    """A hash for every ``rows`` components, different for different bands."""
    parts = point.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for column in parts.T:
        out = mix(out * _STEP + column)
    return out.view(np.int64)
