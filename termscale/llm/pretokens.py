"""Exact pre-tokens of a lower-casing word BPE, and caches of their encodings inside workers.

The library normalises (NFC, white space, lower case), splits by a pattern and merges each pre-token
apart. For texts of common Latin characters, where those steps are plain, the split is done here and each
pre-token is encoded once per worker; any other text goes through the library whole.
"""

import os
import re
import unicodedata
from itertools import pairwise

import numpy as np

# Fixed value: the split pattern of the tokenizer file, with classes spelt out over the characters below.
_RANGE = [chr(c) for c in range(0x180)]
_PUNCTUATION = "‐-‧‰-⁞€"


def _class(kind):
    return "".join(re.escape(c) for c in _RANGE if unicodedata.category(c).startswith(kind))


_LETTERS, _NUMBERS, _SPACES = _class("L"), _class("N"), re.escape("\t\n\x0b\x0c\r \x85\xa0")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")

#: Characters that need the library: beyond Latin Extended-A and common punctuation, and the one Latin
#: capital whose lower case is two characters. "<|" may start a special token.
UNUSUAL = re.compile(f"[^\\x00-įı-ſ{_PUNCTUATION}]|<\\|")

_LOADED = {}


def tokenizer_at(path):
    """The tokenizer of a file, loaded once per process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class PieceCache:
    """What is kept of the encodings of pre-tokens.

    `made(ids, bounds)` gives the values of several pre-tokens, the i-th of which has ids[bounds[i]:bounds[i + 1]].
    `frequent` is a fixed first tier; the cache behind it fills up with misses and is emptied at `limit`
    entries, so memory is bounded whatever the corpus holds.
    """

    def __init__(self, path, made, frequent=None, limit=1 << 19):
        self.tokenizer, self.made, self.limit, self.frequent = tokenizer_at(path), made, limit, frequent or {}
        self.known = dict(self.frequent)
        vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda entry: entry[1])
        self.ends = np.array([token.endswith("</w>") for token, _ in vocabulary])

    def values(self, text):
        """The values of a text's pre-tokens, in order; None if only the library encodes it rightly."""
        if (not text.isascii() or "<|" in text) and UNUSUAL.search(text):
            return None
        found = PIECES.findall(text.lower())
        known = self.known
        try:
            return [known[piece] for piece in found]
        except KeyError:
            pass
        if len(known) > self.limit + len(self.frequent):
            known = self.known = dict(self.frequent)
        missing = [piece for piece in set(found) if piece not in known]
        for start in range(0, len(missing), 512):
            # Each pre-token ends with the one id that stands for the end of a word.
            some = missing[start : start + 512]
            ids = np.array(self.encode(" ".join(some)), np.uint32)
            bounds = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            known.update(zip(some, self.made(ids, bounds), strict=True))
        return [known[piece] for piece in found]

    def encode(self, text):
        """The ids of any text, by the library."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def lengths(ids, bounds):
    """How many ids each pre-token has."""
    return [end - start for start, end in pairwise(bounds)]


def packed_ids(ids, bounds):
    """Each pre-token's ids as little-endian unsigned 16-bit numbers."""
    packed = ids.astype("<u2").tobytes()
    return [packed[2 * start : 2 * end] for start, end in pairwise(bounds)]
