"""Conversations with a legal structure, from turns that were lost, emptied, cut, repeated or given a wrong role.

The search (`conversation_edits`) needs one letter and one fault of each turn, so it runs on narrow rows without texts. They are
dealt by ranges of (conversation, turn), which splits a long conversation over tasks; each task sums up its part
of a conversation by the best edits between any two states, and the few sums of each conversation are joined.
Texts are shuffled once, with the edits in front of them, and streamed: no task holds a conversation's texts.
"""

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscale.llm.conversation_edits import (
    CUT,
    LOST,
    SOUND,
    START,
    finished,
    followed,
    outcome,
    segment_paths,
    whole_path,
)
from termscale.session import written

#: Turns that are searched at once.
SEGMENT = 64
SPACE = " \t\n\x0b\f\r"
LEGAL = {"su", "ua", "au"}
#: Rows of one step of a stream.
ROWS = 4096

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, text of turns; a null role or text is one space."""
    rows = turns.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"))
    return rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text")


ORDER = ["turn", "role", "digest"]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, row_id and fault (blank, duplicate, truncated or none), without texts; a written table."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.right(bare, F.lit(1))
    own = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    narrow = written(rows.select("conv_id", *ORDER, own.alias("own"), F.monotonically_increasing_id().alias("row_id")), "turns")
    # The first of equal turns; only those that occur twice are joined, and a hot one is split by AQE.
    place = F.struct("turn", "row_id")
    again = (
        narrow.filter("own <> 'blank'")
        .groupBy(F.col("conv_id").alias("its_conv"), F.col("role").alias("its_role"), F.col("digest").alias("its_digest"))
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("role") == F.col("its_role"))
    same &= F.col("digest") == F.col("its_digest")
    later = F.col("first").isNotNull() & (F.col("own") != "blank") & (F.col("first.row_id") != F.col("row_id"))
    return narrow.join(again, same, "left").select(
        "conv_id", *ORDER, "row_id", F.when(later, "duplicate").otherwise(F.col("own")).alias("fault")
    )


_FAULTS = {"none": SOUND, "blank": LOST, "duplicate": LOST, "truncated": CUT}


class Stretch:
    """Consecutive turns of a conversation summed up: counts, what lies at both ends, and the best edits by state before and after."""

    def __init__(self, starts):
        self.count = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.first_turn = self.last_turn = None
        self.best = {start: {start: (0, "")} for start in starts}
        self.rows = []
        self.segments = 0

    def add(self, initial, turn, fault):
        if self.last is not None and self.last + initial not in LEGAL:
            self.count["illegal"] += 1
        if fault != "none":
            self.count[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.count["turns"] += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if self.first is None:
            self.first = initial
        self.last = initial
        if len(self.rows) == SEGMENT:
            self.search()
        self.rows.append((initial, _FAULTS[fault]))

    def search(self):
        states = set().union(*self.best.values())
        paths = segment_paths(tuple(self.rows), sorted(states))
        self.best = {start: followed(best, paths) for start, best in self.best.items()}
        self.rows = []
        self.segments += 1

    def closed(self):
        """(cost, edits) of a whole conversation."""
        if not self.segments:
            return whole_path(tuple(self.rows))
        self.search()
        return finished(self.best[START])

    def join(self, other):
        """Take in the stretch that follows, all of whose edits are known."""
        if self.last is not None and self.last + other.first not in LEGAL:
            self.count["illegal"] += 1
        for name in _COUNTS:
            self.count[name] += other.count[name]
        if other.first_turn is not None:
            if self.last_turn == other.first_turn:
                self.count["turns"] -= 1
            self.last_turn = other.last_turn
            if self.first_turn is None:
                self.first_turn = other.first_turn
        self.first, self.last = other.first if self.first is None else self.first, other.last
        self.best = {start: followed(best, other.best) for start, best in self.best.items()}


_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
_PARTS = [
    *((name, pa.int64(), "bigint") for name in _COUNTS),
    ("first", pa.string(), "string"),
    ("last", pa.string(), "string"),
    ("first_turn", pa.int64(), "bigint"),
    ("last_turn", pa.int64(), "bigint"),
    ("cost", pa.int64(), "bigint"),
    ("audit", pa.string(), "string"),
    ("ways", _WAYS, "array<struct<start: int, end: int, cost: bigint, edits: string>>"),
    ("part", pa.int32(), "int"),
]


def _streamed(batches, columns):
    """The rows of all batches as tuples of the given columns."""
    return chain.from_iterable(zip(*(batch.column(c).to_pylist() for c in columns), strict=True) for batch in batches)


def _batches(rows, names, kinds):
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, str))
        if len(held) == ROWS or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def structures(found: DataFrame) -> DataFrame:
    """conv_id, counts, first and last turn, cost and audit of each conversation with turns, from `faults`."""
    kind = dict(found.dtypes)["conv_id"]
    names = ["conv_id", *(name for name, _, _ in _PARTS)]
    schema = f"conv_id {kind}, " + ", ".join(f"`{name}` {sql}" for name, _, sql in _PARTS)

    def row(conv, stretch, part, whole):
        cost, audit = stretch.closed() if whole else (None, None)
        ways = None
        if not whole:
            stretch.search()
            ways = [
                {"start": start, "end": end, "cost": way[0], "edits": way[1]}
                for start, best in stretch.best.items()
                for end, way in best.items()
            ]
        ends = (stretch.first, stretch.last, stretch.first_turn, stretch.last_turn)
        return (conv, *stretch.count.values(), *ends, cost, audit, ways, part)

    def stretches(batches):
        own, stretch, part, inner = None, None, None, False
        for conv, initial, turn, fault, part in _streamed(batches, range(5)):
            if stretch is None or conv != own:
                if stretch is not None:
                    yield row(own, stretch, part, inner)
                # The first conversation of a part may have begun in the part before.
                inner = stretch is not None
                own, stretch = conv, Stretch((START,) if inner else range(4))
            stretch.add(initial, turn, fault)
        if stretch is not None:
            yield row(own, stretch, part, False)

    def summed(batches):
        kinds = None
        batches = iter(batches)
        for first in batches:
            kinds = [first.schema.field(0).type, *(k for _, k, _ in _PARTS)]
            yield from _batches(stretches(chain([first], batches)), names, kinds)

    order = ["conv_id", *ORDER, "row_id"]
    placed = found.repartitionByRange(*order).sortWithinPartitions(*order)
    initial = F.left("role", F.lit(1)).alias("initial")
    narrow = placed.select("conv_id", initial, "turn", "fault", F.spark_partition_id().alias("part"))
    parts = narrow.mapInArrow(summed, schema)

    def join(batches):
        own, joined, known = None, None, None
        for values in _streamed(batches, range(len(names))):
            conv, at = values[0], dict(zip(names, values, strict=True))
            if joined is None or conv != own:
                if joined is not None:
                    yield own, joined, known
                own, joined, known = conv, Stretch((START,)), None
            if at["ways"] is None:
                known = at["cost"], at["audit"]
            best = {}
            for way in at["ways"] or ():
                best.setdefault(way["start"], {})[way["end"]] = (way["cost"], way["edits"])
            other = Stretch(())
            other.count = {name: at[name] for name in _COUNTS}
            other.first, other.last = at["first"], at["last"]
            other.first_turn, other.last_turn = at["first_turn"], at["last_turn"]
            other.best = best if known is None else {START: {START: (0, "")}}
            joined.join(other)
        if joined is not None:
            yield own, joined, known

    def structure(batches):
        for conv, stretch, known in join(batches):
            cost, audit = known or finished(stretch.best[START])
            count = stretch.count
            gaps = 0 if stretch.first_turn is None else stretch.last_turn - stretch.first_turn + 1 - count["turns"]
            yield conv, gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit

    out = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def joined(batches):
        batches = iter(batches)
        for first in batches:
            kinds = [first.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            yield from _batches(structure(chain([first], batches)), ["conv_id", *out, "audit"], kinds)

    together = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return together.mapInArrow(joined, f"conv_id {kind}, " + ", ".join(f"{name} bigint" for name in out) + ", audit string")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, number, role, text of the repaired conversations; conversations in one piece and in order within each partition.

    `audits` has conv_id and audit. Each conversation's edits come before its turns, which are streamed.
    """
    kind = dict(rows.dtypes)["conv_id"]
    turn_kind = dict(rows.dtypes)["turn"]
    edits = audits.select(
        "conv_id",
        F.lit(0).alias("part"),
        F.lit(None).cast(turn_kind).alias("turn"),
        F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"),
        F.col("audit").alias("text"),
    )
    tagged = edits.unionByName(rows.withColumn("part", F.lit(1)))
    placed = tagged.repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)

    def repair(stream):
        edits, at, body, state, number = "", 0, 0, START, 0

        def inserted(conv, end):
            nonlocal at, state, number
            while at < end and edits[at] == "I":
                state, role = outcome(state, "I", None)
                yield conv, number, role, ""
                at, number = at + 1, number + 1

        for conv, part, role, text in stream:
            if part == 0:
                edits, at, body, state, number = text, 0, len(text.rstrip("I")), START, 0
                continue
            yield from inserted(conv, body)
            state, new = outcome(state, edits[at], role[:1])
            at += 1
            if new != "":
                yield conv, number, role if new is None else new, text
                number += 1
            if at == body:
                yield from inserted(conv, len(edits))

    def repaired(batches):
        batches = iter(batches)
        for first in batches:
            kinds = [first.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield from _batches(repair(_streamed(chain([first], batches), range(4))), ["conv_id", "number", "role", "text"], kinds)

    return placed.select("conv_id", "part", "role", "text").mapInArrow(
        repaired, f"conv_id {kind}, number bigint, role string, text string"
    )


def text_digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256: of each conversation's `role:text` lines joined by newlines, for the result of `repaired_turns` as it is."""
    kind = dict(turns.dtypes)["conv_id"]

    def hashed(stream):
        own, digest = None, None
        for conv, role, text in stream:
            if digest is None or conv != own:
                if digest is not None:
                    yield own, digest.hexdigest()
                own, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield own, digest.hexdigest()

    def digests(batches):
        batches = iter(batches)
        for first in batches:
            kinds = [first.schema.field(0).type, pa.string()]
            yield from _batches(hashed(_streamed(chain([first], batches), range(3))), ["conv_id", "sha256"], kinds)

    return turns.select("conv_id", "role", "text").mapInArrow(digests, f"conv_id {kind}, sha256 string")


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The structure of each conversation (a written table, see `structures`) and its repaired turns (see `repaired_turns`).

    `turns` has conv_id, turn, role and text; other columns are not read. A conversation's rows lie in the order of
    turn (null first), role and MD5 of the text. A row's first fault counts: blank (no character but ASCII white space),
    duplicate (role and text of an earlier row), truncated (ends without `.`, `!` or `?`). A null role or text is one
    space; a null conv_id is a conversation like others; rows that repeat are duplicates. `gaps` counts the missing
    turns between the first and the last. Roles other than system, user and assistant go by their first letter, too. An empty
    table gives no rows.
    """
    rows = turn_rows(turns)
    found = written(structures(faults(rows)), "structures")
    return found, repaired_turns(rows, found.select("conv_id", "audit"))
