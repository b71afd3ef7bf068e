"""Small driver-side inputs (queries, word lists, rule tables) as DataFrames, and the size check
that decides whether a caller's table may be broadcast."""

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscale import rules

BROADCAST_BYTES = 64 << 20
#: Size of a scan's split by default.
SPLIT_BYTES = 128 << 20


def local_table(spark: SparkSession, columns: dict) -> DataFrame:
    """{name: (arrow type, values)} as a DataFrame; it becomes part of the plan, no Python task."""
    arrays = [pa.array(values, type=kind) for kind, values in columns.values()]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def broadcast_if_small(df: DataFrame, measured: DataFrame = None, max_bytes=BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast when its values take at most `max_bytes`; larger sides are left to AQE,
    which joins them by a sorted shuffle and splits skewed partitions.

    A string counts with its bytes, any other value with 8, and each row with 16 more. `measured` is a
    table with at least as many rows that is cheaper to measure.
    """
    measured = df if measured is None else measured
    sizes = [F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8) for name, kind in measured.dtypes]
    taken = F.coalesce(F.sum(sum(sizes, F.lit(16))), F.lit(0))
    return F.broadcast(df) if measured.agg(taken).first()[0] <= max_bytes else df


def spread(rows: DataFrame) -> DataFrame:
    """`rows`, dealt out over the cores where the table cannot occupy them: it has fewer files than there are cores, and less
    than one split of the default size for each of them. Larger tables stay in place."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SPLIT_BYTES:
        return rows
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def query_table(spark: SparkSession, queries) -> DataFrame:
    """(query_id, pos, term) from a list of term lists; ids count from 1. A query without terms
    keeps one row with a null term, so that it still gets a ranking."""
    rows = [
        (query_id, pos, term)
        for query_id, terms in enumerate(queries, start=1)
        for pos, term in enumerate(list(terms) or [None])
    ]
    return local_table(
        spark,
        {
            "query_id": (pa.int64(), [r[0] for r in rows]),
            "pos": (pa.int64(), [r[1] for r in rows]),
            "term": (pa.string(), [r[2] for r in rows]),
        },
    )


def word_list(spark: SparkSession, words) -> DataFrame:
    return local_table(spark, {"word": (pa.string(), list(words))})


def union_word_lists(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The distinct words of any number of lists."""
    merged = first.select("word")
    for other in others:
        merged = merged.union(other.select("word"))
    return merged.distinct()


def default_stop_words(spark: SparkSession) -> DataFrame:
    return word_list(spark, rules.stop_words())


def form_table(spark: SparkSession, rows) -> DataFrame:
    """(surface, tag, lemma)"""
    return local_table(
        spark,
        {
            "surface": (pa.string(), [r[0] for r in rows]),
            "tag": (pa.string(), [r[1] for r in rows]),
            "lemma": (pa.string(), [r[2] for r in rows]),
        },
    )


def default_lexicon(spark: SparkSession) -> DataFrame:
    return form_table(spark, rules.lexicon_rows())


def detachment_rules(spark: SparkSession) -> DataFrame:
    rows = rules.detachment_rows()
    return local_table(
        spark,
        {
            "class": (pa.string(), [r[0] for r in rows]),
            "suffix": (pa.string(), [r[1] for r in rows]),
            "replacement": (pa.string(), [r[2] for r in rows]),
            "rule_tag": (pa.string(), [r[3] for r in rows]),
        },
    )
