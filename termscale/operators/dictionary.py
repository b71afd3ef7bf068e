"""A vocabulary whose ids last: later batches add terms behind the ones that are there and change none.

The terms of each batch are a table of their own, listed by a manifest with the first of their ids. New terms are those that no
earlier table has, by an anti-join, numbered in order of first appearance without a one-task window.
"""

from pyspark.sql import DataFrame, SparkSession

from termscale.operators.matrix import FIRST_ORDER, first_places
from termscale.operators.position import number_rows
from termscale.sources.commits import Folder

ATTEMPTS = 5


class Dictionary:
    """term -> term_id in a shared folder; ids count from 0 without gaps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def read(self) -> DataFrame:
        """(term, term_id)"""
        return self._tables(self.folder.entries())

    def _tables(self, entries):
        paths = [f"{self.folder.path}/{entry['folder']}" for entry in entries]
        if not paths:
            return self.spark.createDataFrame([], "term string, term_id long")
        return self.spark.read.schema("term string, term_id long").parquet(*paths)

    def size(self) -> int:
        return max((entry["end"] for entry in self.folder.entries()), default=0)

    def extend(self, index: DataFrame, job: str) -> int:
        """Add the terms of a written index that are not there yet; how many there were. A job that is known adds none.

        Two writers that extend at the same time would give the same ids: the later one sees that and numbers again.
        """
        for _ in range(ATTEMPTS):
            entries = self.folder.entries()
            if self.folder.has(job):
                return 0
            base = max((entry["end"] for entry in entries), default=0)
            found = first_places(index.filter("term is not null"))
            fresh = found.join(self._tables(entries).select("term"), "term", "left_anti")
            name = self.folder.fresh("terms")
            numbered = number_rows(fresh, FIRST_ORDER, "term_id", start=base).select("term", "term_id")
            numbered.write.parquet(f"{self.folder.path}/{name}")
            added = self.spark.read.parquet(f"{self.folder.path}/{name}").count()
            entry = {"job": job, "folder": name, "base": base, "end": base + added}
            done = []

            def change(now, before=entries, entry=entry, done=done):
                done.clear()
                if now != before:
                    return None
                done.append(True)
                return [*now, entry]

            self.folder.commit(change)
            if done:
                return added
        raise RuntimeError(f"{self.folder.path}: other writers were always faster")
