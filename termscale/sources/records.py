"""Tab-separated bibliographic records, and corpora in other formats."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_COLUMNS = ["id", "conf", "title", "author", "year", "abstract", "conf_short", "theme"]
RECORD_SCHEMA = ", ".join(f"{name} STRING" for name in RECORD_COLUMNS)

# A quote opens a field, a doubled quote is a literal one, a backslash is an ordinary character.
FIELD_FORMAT = {"sep": "\t", "quote": '"', "escape": '"'}


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """All eight fields as text. The first line of each file is its header."""
    return spark.read.options(header="true", **FIELD_FORMAT).schema(RECORD_SCHEMA).csv(path)


def parse_record(line: Column) -> Column:
    """One record line as a struct of the eight fields."""
    return F.from_csv(line, F.lit(RECORD_SCHEMA), FIELD_FORMAT)


def as_documents(records: DataFrame) -> DataFrame:
    """(doc_id, text) of parsed records. A missing id or one that is no integer is an error, an
    empty abstract is an empty text."""
    return records.selectExpr(
        "coalesce(CAST(id AS BIGINT), raise_error('record without an integer id')) AS doc_id",
        "coalesce(abstract, '') AS text",
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a tab-separated record file or folder."""
    return as_documents(read_record_lines(spark, path))

