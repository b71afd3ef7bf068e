"""Blocks against dense sums and products."""

import random

import pytest

from pyspark.sql import functions as F

from termscale.operators import blocks as Bl

CELLS = sorted({(random.Random(i).randrange(40), random.Random(-i - 1).randrange(30)) for i in range(300)})
VALUES = {at: random.Random(str(at)).random() for at in CELLS}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(r, c, VALUES[r, c]) for r, c in CELLS], "row_id long, term_id long, weight double").repartition(3)


@pytest.mark.parametrize("layout", ["csr", "csc"])
@pytest.mark.parametrize("rows, columns", [(1, 1), (7, 4), (16, 100), (1024, 4096)])
def test_blocks_hold_every_cell(spark, cells, layout, rows, columns):
    blocks = Bl.block_matrix(cells, layout, rows, columns).collect()
    found = {}
    for block in blocks:
        assert len(block.minors) == len(block["values"]) == block.offsets[-1] <= rows * columns
        assert list(block.majors) == sorted(set(block.majors)) and len(block.offsets) == len(block.majors) + 1
        for i, major in enumerate(block.majors):
            line = block.minors[block.offsets[i] : block.offsets[i + 1]]
            assert line and line == sorted(line)
            for minor, value in zip(line, block["values"][block.offsets[i] : block.offsets[i + 1]]):
                r, c = (major, minor) if layout == "csr" else (minor, major)
                found[block.row_block * rows + r, block.column_block * columns + c] = value
    assert found == VALUES


def test_sums_and_products(spark, cells):
    for rows, columns in ((7, 4), (1024, 4096)):
        for layout, side in (("csr", 0), ("csc", 1)):
            sums = {r.line: r.total for r in Bl.line_sums(Bl.block_matrix(cells, layout, rows, columns), layout, rows, columns).collect()}
            expected = {}
            for at, value in VALUES.items():
                expected[at[side]] = expected.get(at[side], 0) + value
            assert sums == {line: pytest.approx(total) for line, total in expected.items()}
        vectors = {1: {3: 2.0, 17: 1.0}, 2: {99: 1.0}, 3: {0: -1.0, 29: 0.5, 5: 3.0}}
        table = spark.createDataFrame([(q, t, f) for q, v in vectors.items() for t, f in v.items()], "query_id int, term_id long, factor double")
        found = Bl.products(Bl.block_matrix(cells, "csc", rows, columns), table, rows, columns).collect()
        expected = {}
        for (r, c), value in VALUES.items():
            for q, vector in vectors.items():
                if c in vector:
                    expected[q, r] = expected.get((q, r), 0) + value * vector[c]
        assert {(r.query_id, r.row_id): r.score for r in found} == {at: pytest.approx(x) for at, x in expected.items()}


def test_no_cells(spark, cells):
    none = Bl.block_matrix(cells.filter(F.lit(False)))
    assert none.count() == Bl.line_sums(none).count() == 0
    with pytest.raises(ValueError):
        Bl.block_matrix(cells, "dense")


def test_a_block_is_gathered_once(spark, cells):
    # Once and not by line before: each gathering is a partial and a final aggregate. No array grows by copies of itself.
    plan = Bl.block_matrix(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_collect_list(") == 1 and "aggregate(" not in plan.replace("Aggregate(", "")


def test_a_place_with_two_cells_keeps_both(spark):
    cells = spark.createDataFrame([(3, 5, 2.0), (3, 5, 1.0), (2, 5, 4.0)], "row_id long, term_id long, weight double")
    for layout, majors, minors in (("csc", [5], [2, 3, 3]), ("csr", [2, 3], [5, 5, 5])):
        block = Bl.block_matrix(cells, layout).first()
        assert (block.majors, block.minors, block["values"]) == (majors, minors, [4.0, 1.0, 2.0])
