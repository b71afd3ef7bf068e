"""The document-term matrix in compressed blocks: a range of documents by a range of terms in one row.

A block keeps its lines, rows (csr) or columns (csc) that are not empty, as `majors`, where each begins as `offsets`, and behind each other
their `minors` and `values`. It has at most `rows` x `columns` cells, which bounds every group, however frequent a
term or long a document is. Sums and products are made within blocks, and what leaves a block is one number for each line.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions import weights as W
from termscale.operators.matrix import document_term_matrix
from termscale.operators.position import number_rows
from termscale.sources.local import broadcast_if_small

ROWS, COLUMNS = 1024, 4096


def numbered_cells(index: DataFrame, ids: DataFrame = None, k1=W.K1, b=W.B) -> tuple[DataFrame, DataFrame]:
    """(row_id, term_id, weight) of a written index, and (row_id, rec_id, doc_id): documents numbered from 0 in order of their ids."""
    rows = number_rows(index.filter("term is null").select("doc_id", "rec_id"), ["doc_id", "rec_id"], "row_id", start=0)
    cells = document_term_matrix(index, k1, b, ids=ids).select("rec_id", "term_id", "weight")
    return cells.join(rows.select("rec_id", "row_id"), "rec_id").select("row_id", "term_id", "weight"), rows


def block_matrix(cells: DataFrame, layout: str = "csc", rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(row_block, column_block, majors, offsets, minors, values) of cells (row_id, term_id, weight), numbers from 0.

    Cells are shuffled once, by block. A place that has two cells keeps both.
    """
    if layout not in ("csr", "csc"):
        raise ValueError("layout is csr or csc")
    sides = {
        "row": ((F.col("row_id") / rows).cast("bigint"), (F.col("row_id") % rows).cast("int")),
        "column": ((F.col("term_id") / columns).cast("bigint"), (F.col("term_id") % columns).cast("int")),
    }
    major, minor = ("row", "column") if layout == "csr" else ("column", "row")
    width = columns if layout == "csr" else rows
    cell = F.struct((sides[major][1].cast("bigint") * width + sides[minor][1]).alias("at"), "weight").alias("cell")
    placed = cells.select(sides["row"][0].alias("row_block"), sides["column"][0].alias("column_block"), cell)
    placed = placed.repartition("row_block", "column_block")
    # One group and one sort for each block; a line begins where the number of the line changes.
    blocks = placed.groupBy("row_block", "column_block").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    line = f"cells[i].at div {width}"
    starts = f"filter(sequence(0, size(cells) - 1), i -> i = 0 OR {line} <> cells[i - 1].at div {width})"
    blocks = blocks.selectExpr("row_block", "column_block", "cells", f"{starts} AS starts")
    return blocks.selectExpr(
        "row_block",
        "column_block",
        f"transform(starts, i -> CAST({line} AS INT)) AS majors",
        "concat(starts, array(size(cells))) AS offsets",
        f"transform(cells, c -> CAST(c.at % {width} AS INT)) AS minors",
        "cells.weight AS `values`",
    )


def line_sums(blocks: DataFrame, layout: str = "csc", rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(line, total): the sum of each column (csc, by term_id) or row (csr, by row_id) with cells; one number per line and block
    is shuffled."""
    block, width = ("column_block", columns) if layout == "csc" else ("row_block", rows)
    inner = "aggregate(slice(`values`, offsets[i] + 1, offsets[i + 1] - offsets[i]), 0D, (total, v) -> total + v)"
    sums = blocks.selectExpr(block, f"inline(transform(majors, (major, i) -> struct(major, {inner} AS part)))")
    return sums.groupBy((F.col(block) * width + F.col("major")).alias("line")).agg(F.sum("part").alias("total"))


def products(blocks: DataFrame, vectors: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(query_id, row_id, score): the matrix in csc blocks times each of the sparse `vectors` (query_id, term_id, factor).

    A vector meets the blocks of its terms' range and takes only its own lines out of them; rows without a common term do not
    appear.
    """
    asked = vectors.select(
        "query_id",
        (F.col("term_id") / columns).cast("bigint").alias("column_block"),
        (F.col("term_id") % columns).cast("int").alias("asked"),
        "factor",
    )
    met = blocks.join(broadcast_if_small(asked), "column_block")
    met = met.withColumn("i", F.expr("CAST(array_position(majors, asked) AS INT) - 1")).filter("i >= 0")
    part = "slice(%s, offsets[i] + 1, offsets[i + 1] - offsets[i])"
    line = f"zip_with({part % 'minors'}, {part % '`values`'}, (minor, value) -> struct(minor, value))"
    cells = met.selectExpr("query_id", "row_block", "factor", f"inline({line})")
    row = (F.col("row_block") * rows + F.col("minor")).alias("row_id")
    return cells.groupBy("query_id", row).agg(F.sum(F.col("factor") * F.col("value")).alias("score"))
