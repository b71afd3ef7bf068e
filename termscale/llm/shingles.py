"""Word shingles of whole texts as sorted 64-bit codes, in NumPy.

Words are the runs between ASCII white space of the text with A-Z lower-cased. Two shingles are taken for one only
if their 64-bit codes agree, which for sets of a million shingles has a chance of about 3e-8.
"""

import numpy as np
from xxhash import xxh3_64_intdigest

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Codes scattered over all 64 bits, one to one."""
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def shingle_codes(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of `size` words in ascending order; a text of fewer words is one shingle; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    sums = np.full(count, width, np.uint64)
    for i in range(width):
        sums += codes[i : i + count] * _MULTIPLIERS[i]
    return np.unique(mixed(sums))


def set_code(codes: np.ndarray) -> int:
    """A signed 64-bit code of a set of shingles."""
    return int(mixed(codes + np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64))
