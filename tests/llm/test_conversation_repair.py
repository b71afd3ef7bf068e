import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from termscale.llm import conversation_edits as E
from termscale.llm import conversation_repair as C
from termscale.llm.queries import damaged, op13_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def best_by_definition(rows):
    """(cost, edits, states passed) of the least edits by cost and ASCII order: Bellman-Ford over places and states."""
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    given = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {(0, 0): (0, "")}
    changed = True
    while changed:
        changed = False
        for (i, state), (cost, edits) in list(best.items()):
            ways = [("I", 3, i, given[state])]
            if i < len(rows):
                initial, fault = rows[i]
                ways.append(("D", 4, i + 1, state))
                if fault != E.LOST:
                    extra = 3 * (fault == E.CUT)
                    ways.append(("R", 3 + extra, i + 1, given[state]))
                    if (state, initial) in kept:
                        ways.append(("K", extra, i + 1, kept[state, initial]))
            for edit, more, j, to in ways:
                way = (cost + more, edits + edit)
                if way[0] <= 4 * len(rows) and ((j, to) not in best or way < best[j, to]):
                    best[j, to] = way
                    changed = True
    return min(best[len(rows), state] for state in (0, 3) if (len(rows), state) in best)


def test_cheapest_edits_of_all_short_conversations():
    kinds = [(i, f) for i in "sua" for f in (E.SOUND, E.LOST, E.CUT)] + [("t", E.SOUND)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert E.whole_path(rows) == best_by_definition(rows), rows


def drawn(draw, n):
    kinds = ["s", "u", "a", "u", "a", "u", "a", "t", ""]
    return tuple((draw.choice(kinds), draw.choice([0, 0, 0, 0, 1, 2])) for _ in range(n))


def test_cheapest_edits_of_longer_conversations():
    draw = random.Random(2)
    for _ in range(60):
        rows = drawn(draw, draw.randint(4, 24))
        assert E.whole_path(rows) == best_by_definition(rows), rows


def test_segments_join_to_the_whole():
    draw = random.Random(4)
    for _ in range(60):
        rows = drawn(draw, draw.randint(1, 20))
        best, at = {E.START: (0, "")}, 0
        while at < len(rows):
            size = draw.randint(1, 6)
            best = E.followed(best, E.segment_paths(rows[at : at + size]))
            at += size
        assert E.finished(best) == E.whole_path(rows)


def expected(turns):
    """{conv_id: result} of (conv_id, turn, role, text) rows, by the definition."""
    result = {}
    for conv in {row[0] for row in turns}:
        rows = []
        for own, turn, role, text in turns:
            if own != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fate = zlib.crc32(key.encode()) % 20
            if fate == 1:
                text = ""
            if fate == 2:
                text = text.translate(str.maketrans("", "", ".!?"))
            if fate == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        seen, marked = set(), []
        for k, (_, role, text) in enumerate(rows):
            fault = E.SOUND
            if not text.strip(SPACE):
                count["blank"] += 1
                fault = E.LOST
            elif (role, text) in seen:
                count["duplicate"] += 1
                fault = E.LOST
            elif text.rstrip(SPACE)[-1] not in ".!?":
                count["truncated"] += 1
                fault = E.CUT
            seen.add((role, text))
            count["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            marked.append((role[:1], fault))
        numbers = {r[0] for r in rows if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = E.whole_path(tuple(marked)) if len(rows) > 30 else best_by_definition(marked)
        lines, state, left = [], "", iter(rows)
        for edit in audit:
            given = "a" if state == "u" else "u"
            if edit == "I":
                lines.append(("user" if given == "u" else "assistant") + ":")
                state = given
                continue
            _, role, text = next(left)
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = role[:1]
            if edit == "R":
                lines.append(("user" if given == "u" else "assistant") + f":{text}")
                state = given
        assert next(left, None) is None
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, *count.values(), cost, audit, digest)
    return result


def found(spark, path):
    rows = op13_conversation_repair(spark, str(path)).collect()
    made = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(made) == len(rows)
    return made


def test_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    made = found(spark, "/root/testdata/sf0.001")
    assert made == expected([tuple(t) for t in turns])


ROLES = ["user", "assistant", "system", "tool", "", None]


def test_odd_rows(spark, tmp_path, monkeypatch):
    draw = random.Random(9)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(draw.randint(1, 9)):
            turn = draw.choice([None, *range(6)])
            text = draw.choice(["Yes.", "No!", "cut", " \t", "", None, "Is it?\n", "x\x85", f"{turn} {conv}."])
            rows.append((conv, turn, draw.choice(ROLES), text))
    # Long conversations: a third of all rows in one, and one whose rows are all the same.
    rows += [(100, i, ["user", "assistant"][i % 2], f"turn {i}." if i % 7 else "cut") for i in range(300)]
    rows += [(101, 5, "user", "Again.")] * 90
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, part string")
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(C, "ROWS", 7)
    assert found(spark, tmp_path) == expected(rows)


def test_no_conversations(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(0)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(spark, tmp_path) == {}


def test_all_turns_of_a_conversation_dropped(spark):
    turns = spark.range(2000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'Hm.' AS text")
    kept = damaged(turns).select("conv_id").distinct().count()
    assert kept < 2000 and damaged(turns).filter(F.col("conv_id").isNull()).count() == 0


def test_turns_of_a_repaired_conversation(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "More?"), (1, 2, "user", "  "), (2, 0, "assistant", "Well.")]
    structure, turns = C.repair_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert {r.conv_id: r.audit for r in structure.collect()} == {1: "KRD", 2: "IK"}
    assert sorted(map(tuple, turns.collect())) == [
        (1, 0, "user", "Hello."),
        (1, 1, "assistant", "More?"),
        (2, 0, "user", ""),
        (2, 1, "assistant", "Well."),
    ]
