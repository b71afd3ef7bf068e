"""Parts of an Arrow batch that are worked on together."""


def portions(sizes: list[int], most: int):
    """Slices of rows that follow each other, each of at most `most` in size or of one row."""
    start, taken = 0, 0
    for i, size in enumerate(sizes):
        if i > start and taken + size > most:
            yield slice(start, i)
            start, taken = i, 0
        taken += size
    if start < len(sizes):
        yield slice(start, len(sizes))
