"""Passages of texts as numeric vectors, made for many texts at once in NumPy."""

import numpy as np

PASSAGE_WORDS = 64
BUCKETS = 256
STATISTICS = 10
WIDTH = BUCKETS + STATISTICS
#: Texts are encoded in groups of about so many bytes.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_classes():
    """Each byte's class: letters alone, capitals, digits and white space together, other bytes by their low bits."""
    classes = 40 + np.arange(256) % 24
    classes[ord("a") : ord("z") + 1] = np.arange(26)
    classes[ord("A") : ord("Z") + 1] = 26
    classes[ord("0") : ord("9") + 1] = 27
    classes[_SPACE] = 28
    classes[10] = 29
    return classes.astype(np.int32)


_CLASSES = _byte_classes()
_PAIRS = np.random.default_rng(3).integers(0, BUCKETS, 64 * 64).astype(np.int64)
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def encode_group(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of some texts, and how many passages each text has (one at least)."""
    coded = [text.encode() + b"\n" for text in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    ends = np.cumsum([len(c) for c in coded])
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    words = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(passages) - passages
    total = int(passages.sum())
    in_text = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    of_word = np.repeat(base, words) + in_text // PASSAGE_WORDS
    # White space belongs to the word before it; what stands before a text's first word to its first passage.
    text_starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    marks = np.concatenate([text_starts, starts])
    order = np.argsort(marks, kind="stable")
    marks, owner = marks[order], np.concatenate([base, of_word])[order]
    of_byte = np.repeat(owner, np.diff(np.concatenate([marks, [len(data)]])))

    classes = _CLASSES[data]
    pair = _PAIRS[classes[:-1] * 64 + classes[1:]]
    place = of_byte[:-1] * BUCKETS + pair
    # Pairs of bytes of two texts go to a place of their own, which is cut off.
    place[ends[:-1] - 1] = total * BUCKETS
    counts = np.bincount(place, minlength=total * BUCKETS + 1)[:-1].reshape(total, BUCKETS)
    size = np.bincount(of_byte, minlength=total)
    length = np.bincount(of_word, minlength=total)

    def share(mask):
        return np.bincount(of_byte[mask], minlength=total) / np.maximum(size, 1)

    if len(starts):
        begun = np.zeros(len(data), np.int64)
        begun[starts] = starts
        position = np.arange(len(data)) - np.maximum.accumulate(begun)
        lower = np.where((data >= 65) & (data <= 90), data + 32, data)
        values = np.where(space, np.uint64(0), (lower.astype(np.uint64) + np.uint64(1)) * _PLACES[position & 255])
        hashes = np.add.reduceat(values, starts)
        keys = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        distinct = np.bincount((fresh >> np.uint64(40)).astype(np.int64), minlength=total)
    else:
        distinct = np.zeros(total)
    one = np.maximum(length, 1)
    statistics = [
        np.log1p(length),
        distinct / one,
        (size - np.bincount(of_byte[space], minlength=total)) / one / 10,
        share((data >= 65) & (data <= 90)),
        share((data >= 48) & (data <= 57)),
        share((data < 128) & ~space & (classes >= 40)),
        share(data >= 128),
        share(data == 10) * 10,
        share(space),
        (length == 0).astype(float),
    ]
    shares = np.log1p(100 * counts / np.maximum(size, 1)[:, None])
    return np.hstack([shares, np.stack(statistics, axis=1)]).astype(np.float32), passages


def encode_passages(texts: list[str | None]):
    """(vectors, passages) of consecutive groups of texts; a null text counts as empty."""
    group, weight = [], 0
    for text in texts:
        group.append(text or "")
        weight += len(group[-1])
        if weight >= CHUNK_BYTES:
            yield encode_group(group)
            group, weight = [], 0
    if group:
        yield encode_group(group)
