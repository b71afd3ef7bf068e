"""Consecutive numbers for ordered rows, and the split of a corpus by position."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscale.session import written


def number_rows(df: DataFrame, order, name: str, start=1) -> DataFrame:
    """Add consecutive numbers in the order of the given columns, without a one-task window.

    Rows are range-partitioned and sorted, and written together with their place in their
    partition; the sizes of the earlier partitions, one row per partition, are then added.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("earlier"))
    in_part = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn(name, in_part + F.col("earlier") + start)
        .drop("part", "place", "earlier")
    )


def document_positions(documents: DataFrame) -> DataFrame:
    """(doc_id, rec_id, doc_pos): place of each document in ascending id order, from 1. Equal ids
    keep their order in the input, and may lie in different partitions."""
    if "rec_id" not in documents.columns:
        documents = documents.selectExpr("doc_id", "monotonically_increasing_id() AS rec_id")
    return number_rows(documents.select("doc_id", "rec_id"), ["doc_id", "rec_id"], "doc_pos")


def with_half(rows: DataFrame) -> DataFrame:
    """A written index with a column `half`: 1 for the first half of its documents (rounded down), 2 for the rest.

    The last document of the first half, one row, becomes a constant. Null ids come first, as they do in
    the order of documents.
    """
    documents = rows.filter("term is null")
    half = documents.count() // 2
    last = document_positions(documents).filter(F.col("doc_pos") == half).select("doc_id", "rec_id").first()
    if last is None:
        return rows.withColumn("half", F.lit(2))
    same_id = F.col("doc_id").eqNullSafe(F.lit(last.doc_id)) & (F.col("rec_id") <= F.lit(last.rec_id))
    in_first = same_id
    if last.doc_id is not None:
        in_first = same_id | F.col("doc_id").isNull() | (F.col("doc_id") < F.lit(last.doc_id))
    return rows.withColumn("half", F.when(in_first, 1).otherwise(2))
