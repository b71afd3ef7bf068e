"""Exact deduplication against a persistent digest index.

The index is a bucketed table, sorted by digest within each bucket. A batch is reduced to one row per
digest (combined before the shuffle, so a group of copies never meets in one task), the digests that
the index lacks are found by a sort-merge anti-join that does not move the index, and are appended.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscale.llm.columns import unused
from termscale.session import written

#: A digest that holds more than one row in so many is hot; there can be no more hot digests than this.
HOT_DIGESTS = 1000


def normalised(text):
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    spaces = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaces, " {2,}", " ")


def digest_of(text):
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and SHA-256 of the normalised text, one row per row of `docs`."""
    return docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id) in the warehouse, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The rows of `groups`, one per digest, whose digest is not indexed."""
        if not self.exists():
            return groups
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id) rows; they must be new to the index."""
        writer = rows.select("digest", "keep_id").repartition(self.buckets, "digest").write
        writer.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; new digests enter `index`.

    Texts are equal when they are the same after `normalised`. `keep_id` is the smallest id of the
    group, or the id that the index already has for the text; `group_size` counts the rows of this batch.
    A null or empty text is the empty text. Null ids are skipped when the smallest id is chosen; a group
    with null ids only has a null keep_id, and its rows count as kept. Rows that repeat both id and text
    are alike, so all of them or none are kept. Other columns of `docs` are not read. An empty batch
    gives no rows.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    counted = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(counted, "digest-groups")
    index.append(index.lacking(groups))
    found = groups.select("digest", "group_size").join(index.read().hint("merge"), "digest")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("total"))
    # Fewer than HOT_DIGESTS digests can have more than 1 / HOT_DIGESTS of all rows each: broadcast those.
    hot = found.join(F.broadcast(total), F.col("group_size") * HOT_DIGESTS > F.col("total")).drop("total")
    hot = written(hot, "hot-digests")
    common = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(found.hint("merge"), "digest")
    return common.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def first_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `deduplicate` keeps, with all their columns."""
    kept_id, kept_text, own_text = (unused(docs, name) for name in ("kept_id", "kept_text", "own_text"))
    kept = deduplicate(docs, index, id_col, text_col).filter("kept")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_text)).distinct()
    # An id alone does not name a row: null and repeated ids can have texts that are kept and texts that are not.
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own_text) == F.col(kept_text))
    return docs.withColumn(own_text, digest_of(F.col(text_col))).join(kept, same, "left_semi").drop(own_text)
