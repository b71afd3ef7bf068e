"""Signatures for an exact Jaccard join by universe partition, size bands and one-deletion neighbourhoods.

Sets of a size band hash their elements into the same segments of the universe. Two sets with Jaccard
similarity `numerator`/`denominator` or more differ in at most H elements, so among segments whose needs add up to
H + 1, one need is met: a segment with need 1 is met when both parts are equal, one with need 2 also when they differ by
one element, which shows as a part of one set being equal to the other's part with one element deleted.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from termscale.llm.shingles import mixed

#: Upper sizes of neighbouring bands are this far apart.
BAND_RATIO = 1.5
#: The costs that an allocation weighs: a signature costs 1; chance partners of a segment cost RIVALS, times
#: ALIKE for each element that they would have to share.
RIVALS, ALIKE = 256.0, 0.25
#: Segments with need 1 are made in excess by this factor, and each set indexes its largest ones.
EXCESS = 1.5


@dataclass(frozen=True)
class Band:
    """Sizes low..high of the smaller set; `near` segments with need 2, then `exact` ones with need 1."""

    number: int
    low: int
    high: int
    near: int
    exact: int


def most_different(size_a: int, size_b: int, numerator: int, denominator: int) -> int:
    """How many elements similar sets of these sizes can have apart."""
    return (denominator - numerator) * (size_a + size_b) // (denominator + numerator)


def allocate(apart: int, size: int) -> tuple[int, int]:
    """The cheapest (near, exact) with 2 near + exact = apart + 1, for sets of about `size` elements."""

    def cost(near):
        exact = apart + 1 - 2 * near
        part = size / (near + exact)
        equal = exact * (1 + RIVALS * ALIKE**part)
        return equal + near * (1 + part) * (1 + RIVALS * ALIKE ** max(part - 1, 0))

    best = min(range((apart + 1) // 2 + 1), key=cost)
    return best, apart + 1 - 2 * best


@lru_cache
def bands(largest: int, numerator: int, denominator: int) -> tuple[Band, ...]:
    """Bands up to the size `largest`."""
    made, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        apart = most_different(high, high * denominator // numerator, numerator, denominator)
        near, exact = allocate(apart, high)
        made.append(Band(len(made), low, high, near, exact + int(exact * (EXCESS - 1))))
        low = high + 1
    return tuple(made)


def _signatures(codes, band, apart):
    """Signatures of one set for one band, given how far apart a partner can be."""
    segments = band.near + band.exact
    if apart < 1:
        return None
    place = ((codes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    # The codes are sorted, and so are their segments.
    bounds = np.searchsorted(place, np.arange(segments + 1, dtype=np.uint64))
    values = mixed(codes ^ np.uint64(0x2545F4914F6CDD1D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    parts, sizes = sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds)
    tags = mixed(np.arange(segments, dtype=np.uint64) + np.uint64(band.number << 32))
    found = []
    if band.near:
        taken = bounds[band.near]
        owner = place[:taken].astype(np.int64)
        found += [mixed(parts[: band.near] + tags[: band.near]), mixed(parts[owner] - values[:taken] + tags[owner])]
    wanted = apart + 1 - 2 * band.near
    if wanted > 0:
        keys = mixed(parts[band.near :] + tags[band.near :])
        # One order of parts for all sets: the larger first, as they are the rarer, equal sizes by key.
        first = np.lexsort((keys, -sizes[band.near :]))[:wanted]
        found.append(keys[first])
    return np.concatenate(found)


def signatures(codes: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Signatures of a set such that similar sets share at least one, unless they are equal.

    A pair meets in the band of its smaller set: every set is entered in its own band, and in the one below if a
    similar smaller set can lie there.
    """
    size = len(codes)
    if not size:
        return np.zeros(0, np.uint64)
    all_bands = bands(1 << max(4, size.bit_length()), numerator, denominator)
    own = next(b for b in all_bands if b.low <= size <= b.high)
    found = [_signatures(codes, own, most_different(size, size * denominator // numerator, numerator, denominator))]
    smallest, below = -(-size * numerator // denominator), own.number - 1
    while below >= 0 and all_bands[below].high >= smallest:
        band = all_bands[below]
        found.append(_signatures(codes, band, most_different(band.high, size, numerator, denominator)))
        below -= 1
    found = [f for f in found if f is not None]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
