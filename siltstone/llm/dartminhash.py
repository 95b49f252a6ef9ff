"""DartMinHash signatures of weighted sets, vectorised over many sets.

Every element throws darts at the plane weight x rank: a Poisson process of rate 1 whose darts
depend on the element alone. The plane is cut into regions (weight bands doubling from 1, rank
bands growing by the square root of 2), each with its own seed, so that darts are made region by
region. A set keeps the darts below its elements' weights; each dart falls to one of ``t``
coordinates, and the dart of least rank per coordinate is the signature. Rank bands are opened in
order until no coordinate is empty, so about ``t ln t + 2 t`` darts are thrown per set whatever its size.
Two signatures agree in a coordinate with the probability of the sets' weighted Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from siltstone.llm.textwork import mix

#: Upper end of the first rank band, and bits of a rank below the point.
FIRST_RANK = 1.0
RANK_BITS = 24
EMPTY = np.uint64(2**64 - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_COUNTS: dict[float, np.ndarray] = {}


def _counts(mean: float) -> np.ndarray:
    """Poisson counts by 16 random bits."""
    if mean not in _COUNTS:
        most = int(mean + 12 * math.sqrt(mean) + 20)
        log_p = [-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(most)]
        _COUNTS[mean] = np.searchsorted(np.cumsum(np.exp(log_p)), (np.arange(1 << 16) + 0.5) / (1 << 16))
    return _COUNTS[mean]


def _darts(elements: np.ndarray, region: int, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the element, 64 random bits) of every dart of a region."""
    seeded = mix(elements ^ np.uint64((region * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64))
    counts = _counts(mean)[seeded >> np.uint64(48)]
    of = np.repeat(np.arange(len(elements)), counts)
    # the j-th dart of an element is its seed plus j steps of a Weyl sequence
    first = np.cumsum(counts) - counts
    seeded -= first.astype(np.uint64) * STEP
    bits = np.arange(1, len(of) + 1, dtype=np.uint64)
    bits *= STEP
    bits += seeded[of]
    return of, mix(bits)


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, t: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(n_sets, t) ranks of the winning darts. ``owner`` ascends; sets without elements keep EMPTY.

    ``elements`` are 64-bit ids, distinct within a set; ``weights`` default to 1 and must be positive.
    """
    out = np.full(n_sets * t, EMPTY, dtype=np.uint64)
    open_sets = np.zeros(n_sets, dtype=bool)
    open_sets[owner] = True
    heaviest = float(weights.max()) if weights is not None and len(weights) else 1.0
    bands = [(0.0, 1.0)]
    while bands[-1][1] < heaviest:
        bands.append((bands[-1][1], bands[-1][1] * 2))
    low, high, step = 0.0, FIRST_RANK, 0
    while len(elements) and open_sets.any():
        at = np.flatnonzero(open_sets[owner])
        for level, (w_low, w_high) in enumerate(bands):
            own = at if level == 0 else at[weights[at] > w_low]
            of, bits = _darts(elements[own], step * 64 + level, (w_high - w_low) * (high - low))
            of = own[of]
            if weights is not None:
                spot = w_low + (mix(bits) >> np.uint64(11)).astype(np.float64) * (2.0**-53 * (w_high - w_low))
                kept = spot < weights[of]
                of, bits = of[kept], bits[kept]
            rank = bits >> np.uint64(32)
            rank *= np.uint64((high - low) * 2.0**RANK_BITS)
            rank >>= np.uint64(32)
            rank += np.uint64(low * 2.0**RANK_BITS)
            bits &= np.uint64(0xFFFFF)
            bits *= np.uint64(t)
            bits >>= np.uint64(20)
            np.minimum.at(out, owner[of] * t + bits.view(np.int64), rank)
        open_sets &= (out.reshape(n_sets, t) == EMPTY).any(axis=1)
        low, high, step = high, high * math.sqrt(2), step + 1
    return out.reshape(n_sets, t)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys; equal where all ``rows`` coordinates of a band agree."""
    s = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key
