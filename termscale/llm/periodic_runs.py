"""Runs of words that repeat with a period three times or more, and texts without the repetitions.

A run of period q and length 3q covers three neighbouring multiples of q, where it has the same word. Such
places, of all q the harmonic grid, are the candidates: n log n comparisons of words. Grammars of `recompression`
give the exact ends of the run through each candidate. The texts of one step share one grammar.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.llm.portions import portions
from termscale.llm.recompression import Grammar

LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Words whose runs are sought together; a longer text is a step of its own.
AT_ONCE = 1 << 18
#: Grid points that are held at once.
GRID = 1 << 21


def _grid(words, bounds, sizes, least):
    """(period, place) of grid points followed by the same word one and two periods later, in groups of periods.

    `sizes` fall, so the texts that are long enough for a period are the first ones.
    """
    periods, places, held = [], [], 0
    enough = len(sizes)
    for q in range(1, int(sizes[0]) // LEAST_PERIODS + 1):
        while sizes[enough - 1] < max(least, LEAST_PERIODS * q):
            enough -= 1
        grid = words[: bounds[enough] : q]
        found = np.flatnonzero((grid[:-2] == grid[1:-1]) & (grid[1:-1] == grid[2:]))
        if len(found):
            places.append(found * q)
            periods.append(np.full(len(found), q))
            held += len(found)
        # Within a group no period is a multiple of another, nor are many points held.
        if held and (held > GRID or (q + 1) & q == 0):
            yield np.concatenate(periods), np.concatenate(places)
            periods, places, held = [], [], 0
    if held:
        yield np.concatenate(periods), np.concatenate(places)


def runs_of(texts: list[np.ndarray], least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of each text's runs, by start and period. Texts are arrays of word numbers."""
    found = [[] for _ in texts]
    order = [i for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])) if len(texts[i]) >= least]
    if not order:
        return found
    # Each text is followed by a number of its own; one more comes first.
    top = max(int(texts[i].max()) for i in order) + 2
    parts = [np.array([top - 1])]
    for k, i in enumerate(order):
        parts += [texts[i], np.array([top + k])]
    words = np.concatenate(parts)
    sizes = np.array([len(texts[i]) for i in order])
    bounds = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    forward = backward = None
    kept = {}
    for periods, places in _grid(words, bounds, sizes, least):
        if forward is None:
            forward = Grammar(words)
            backward = forward.mirrored()
        width = len(words)
        while len(places):
            # Of points that follow each other by one period, the first stands for the run through all of them.
            keys = periods * width + places
            place_of = np.sort(keys)
            before = keys - periods
            at = np.minimum(np.searchsorted(place_of, before), len(place_of) - 1)
            heads = place_of[at] != before
            q, i = periods[heads], places[heads]
            right = forward.extensions(i, i + q)
            left = backward.extensions(width - i, width - i - q)
            starts, lengths = i - left, left + q + right
            for s, n, p in zip(starts.tolist(), lengths.tolist(), q.tolist(), strict=True):
                if n >= max(least, LEAST_PERIODS * p):
                    # Periods rise, and a run's smallest period divides its others.
                    kept.setdefault((s, n), p)
            # What lies in the stretches just found is settled.
            by = np.argsort(q * width + starts, kind="stable")
            key, ends = (q * width + starts)[by], (starts + lengths)[by]
            at = np.searchsorted(key, keys, side="right") - 1
            owner = np.maximum(at, 0)
            inside = (at >= 0) & (key[owner] // width == periods) & (places + 2 * periods < ends[owner])
            rest = ~(heads | inside)
            periods, places = periods[rest], places[rest]
    for (start, length), period in sorted(kept.items(), key=lambda run: (run[0][0], run[1])):
        k = int(np.searchsorted(bounds, start, side="right")) - 1
        found[order[k]].append((start - int(bounds[k]), length, period))
    return found


def collapsed(words: list[bytes], runs) -> bytes:
    """The words but those of a run after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([word for word, n in zip(words, np.cumsum(change).tolist(), strict=False) if not n])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH
) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), collapsed (text), one row per row of `docs`.

    Words are separated by ASCII white space and compared byte by byte. A run is a stretch of at least `least` words
    and three of its smallest periods that keeps the period with no neighbouring word. `collapsed` has the words
    that no run contains after its first period, joined by one space. A null or empty text has no words, no runs
    and an empty text. Repeated rows stay, a null id stays null, other columns are not read, an empty table gives
    no rows. A text is never cut; a step holds about 30 numbers for each word of its longest text.
    """

    def find(batches):
        for batch in batches:
            texts = [text.split() for text in batch.column(1).to_pylist()]
            for part in portions([len(words) for words in texts], AT_ONCE):
                own = texts[part]
                code = {}
                numbers = [np.array([code.setdefault(w, len(code)) for w in words], np.int64) for words in own]
                runs = runs_of(numbers, least)
                joined = [collapsed(words, found) for words, found in zip(own, runs, strict=True)]
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                named = [[dict(zip(names, run, strict=True)) for run in found] for found in runs]
                columns = [ids, pa.array(named, kind), pa.array(joined, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    names = ("start", "length", "period")
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in names]))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return rows.mapInArrow(find, f"doc_id {dict(rows.dtypes)['doc_id']}, runs {runs}, collapsed string")


def greatest_run(runs):
    """Of an array of runs the one of greatest length per period, then of smallest start and period; null for none.
    Products are compared, so equal quotients are ties."""

    def better(best, run):
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (a > b), run).otherwise(best)

    # In order of start and period, so of equals the first stays.
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), better)
