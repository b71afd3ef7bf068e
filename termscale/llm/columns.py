"""Column names that do not clash with a caller's."""

from pyspark.sql import DataFrame


def unused(table: DataFrame, name: str) -> str:
    """`name`, lengthened until the table has no such column."""
    taken = {column.lower() for column in table.columns}
    while name.lower() in taken:
        name += "_"
    return name
