"""An index that grows by immutable segments.

Each batch of documents is analysed once and becomes a segment: its index rows and its document frequencies. A manifest
lists the segments with their numbers of documents and tokens, so statistics of the whole are sums of small tables. Deleted
ids are a table of their own, which hides the rows of the segments before it. Compaction writes one segment of all.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscale.operators.index import document_frequency, index_rows
from termscale.sources.commits import Folder
from termscale.sources.local import broadcast_if_small

ROWS, TERMS = "rows", "terms"


class SegmentedIndex:
    """The index in a shared folder. Ids of deleted documents may come again in later batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def append(self, docs: DataFrame, job: str, stop: DataFrame = None, lexicon: DataFrame = None) -> bool:
        """Add a batch of (doc_id, text) documents under the name of a job; False if that job has been added before."""
        if self.folder.has(job):
            return False
        name = self.folder.fresh("segment")
        index_rows(docs, stop, lexicon).write.parquet(f"{self.folder.path}/{name}/{ROWS}")
        return self._add(name, job)

    def _add(self, name, job, replaced=()):
        """List a written segment, in place of others."""
        rows = self.spark.read.parquet(f"{self.folder.path}/{name}/{ROWS}")
        document_frequency(rows).write.parquet(f"{self.folder.path}/{name}/{TERMS}")
        sums = rows.filter("term is null").agg(
            F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"), F.max("rec_id").alias("last")
        )
        sums = sums.first()
        added = False
        gone = {entry["folder"] for entry in replaced}

        def change(entries):
            nonlocal added
            added = False
            known = {entry["folder"] for entry in entries}
            if any(job in (entry["job"], *entry.get("jobs", ())) for entry in entries) or not gone <= known:
                return None
            left = [entry for entry in entries if entry["folder"] not in gone]
            entry = {"kind": "segment", "job": job, "folder": name, "n_docs": sums.n_docs, "total_len": sums.total_len}
            if gone:
                # What came in the meantime stays behind; its record numbers are beyond those of the replaced segments.
                entry |= {"seq": min(e["seq"] for e in replaced), "base": 0, "end": max(e["end"] for e in replaced)}
                entry["jobs"] = [j for e in replaced for j in (e["job"], *e.get("jobs", ()))]
            else:
                base = max((e["end"] for e in entries), default=0)
                entry |= {"seq": 1 + max((e["seq"] for e in entries), default=0), "base": base, "end": base + 1 + (sums.last or 0)}
            added = True
            return [*left, entry]

        self.folder.commit(change)
        return added

    def delete(self, ids: DataFrame, job: str) -> bool:
        """Hide all documents added so far whose `doc_id` is among the ids; False if that job is known. A null id names none."""
        if self.folder.has(job):
            return False
        name = self.folder.fresh("deletes")
        ids.select("doc_id").filter("doc_id is not null").distinct().write.parquet(f"{self.folder.path}/{name}")
        added = False

        def change(entries):
            nonlocal added
            added = not any(job in (entry["job"], *entry.get("jobs", ())) for entry in entries)
            if not added:
                return None
            seq, end = (max((e[key] for e in entries), default=0) for key in ("seq", "end"))
            return [*entries, {"kind": "delete", "job": job, "folder": name, "seq": seq + 1, "end": end}]

        self.folder.commit(change)
        return added

    def _parts(self, entries=None):
        entries = self.folder.entries() if entries is None else entries
        return [e for e in entries if e["kind"] == "segment"], [e for e in entries if e["kind"] == "delete"]

    def _tables(self, entries, part=""):
        """The rows of several data folders, each with the columns `seq` and `base` of its entry."""
        found = None
        for entry in entries:
            rows = self.spark.read.parquet(f"{self.folder.path}/{entry['folder']}{part}")
            rows = rows.withColumns({"seq": F.lit(entry["seq"]).cast("long"), "base": F.lit(entry.get("base", 0)).cast("long")})
            found = rows if found is None else found.unionByName(rows)
        return found

    def _split(self, how, entries=None):
        """Index rows that deletes do not hide (left_anti) or do (left_semi), with record ids that are unique in the whole."""
        segments, deletes = self._parts(entries)
        if not segments:
            raise ValueError(f"{self.folder.path}: no segment")
        rows = self._tables(segments, f"/{ROWS}").withColumn("rec_id", F.col("rec_id") + F.col("base")).drop("base")
        if not deletes:
            return rows.drop("seq") if how == "left_anti" else rows.drop("seq").limit(0)
        # The last delete of an id hides all segments before it.
        hidden = self._tables(deletes).groupBy("doc_id").agg(F.max("seq").alias("hides"))
        hidden = hidden.withColumnRenamed("doc_id", "hidden_id")
        same = (F.col("doc_id") == F.col("hidden_id")) & (F.col("seq") < F.col("hides"))
        return rows.join(broadcast_if_small(hidden), same, how).drop("seq")

    def read(self) -> DataFrame:
        """The index rows of all documents that are not deleted, as `index_rows` of them together."""
        return self._split("left_anti")

    def statistics(self) -> DataFrame:
        """One row (n_docs, total_len, avg_len): sums of the manifest, less the deleted documents."""
        segments, deletes = self._parts()
        n_docs, total_len = (sum(entry[key] for entry in segments) for key in ("n_docs", "total_len"))
        gone = (0, 0)
        if deletes and segments:
            lost = self._split("left_semi").filter("term is null")
            gone = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        n_docs, total_len = n_docs - gone[0], total_len - gone[1]
        average = total_len / n_docs if n_docs else None
        return self.spark.createDataFrame([(n_docs, total_len, average)], "n_docs long, total_len long, avg_len double")

    def document_frequency(self) -> DataFrame:
        """(term, df): the sum of the segments' tables, less the deleted documents' terms; the postings are not read."""
        segments, deletes = self._parts()
        if not segments:
            raise ValueError(f"{self.folder.path}: no segment")
        terms = self._tables(segments, f"/{TERMS}").select("term", "df")
        if deletes:
            lost = self._split("left_semi").filter("term is not null").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            terms = terms.unionByName(lost)
        return terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def compact(self, job: str) -> bool:
        """One segment in place of all segments and deletes; False if there is none, or if others were compacted meanwhile."""
        entries = self.folder.entries()
        if not self._parts(entries)[0] or self.folder.has(job):
            return False
        name = self.folder.fresh("segment")
        self._split("left_anti", entries).write.parquet(f"{self.folder.path}/{name}/{ROWS}")
        return self._add(name, job, replaced=entries)
