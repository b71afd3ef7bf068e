"""Writers for rankings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscale.sources.commits import Folder


def write_ranking(ranking: DataFrame, path: str, fmt="parquet", mode="append"):
    """Write a ranking as rows; `mode` is 'append' or 'overwrite'."""
    ranking.write.mode(mode).format(fmt).save(path)


def ranking_lines(ranking: DataFrame, item: str) -> DataFrame:
    """(query_id, value): one line of text per query, `[(item, score), ...]` in rank order; a
    ranking without queries gives one line.

    A group holds the k rows of one query, so it is as small as k.
    """
    if "query_id" not in ranking.columns:
        ranking = ranking.withColumn("query_id", F.lit(1))
    entry = f"struct(rank, concat('(', {item}, ', ', score, ')') AS entry)"
    lines = ranking.groupBy("query_id").agg(F.expr(f"array_sort(collect_list({entry})) AS entries"))
    return lines.selectExpr("query_id", "concat('[', array_join(transform(entries, e -> e.entry), ', '), ']') AS value")


def write_ranking_lines(ranking: DataFrame, item: str, path: str, mode="append"):
    """Write the lines of `ranking_lines` as text in query order, k entries per query, in as many files as the
    range partitions of the queries need."""
    lines = ranking_lines(ranking, item).repartitionByRange("query_id").sortWithinPartitions("query_id")
    lines.select("value").write.mode(mode).text(path)


def publish(spark: SparkSession, path: str, results: dict, job: str, mode="append") -> bool:
    """Write several results under one commit: all of them become visible, or none. False if the job is known already.

    `results` maps a label to a function that writes to the path it is given. `mode` 'overwrite' lists only this job from
    then on, in the same commit; readers that began before go on with what they saw. A job that fails leaves data that no
    manifest lists, and can be run again under its name.
    """
    folder = Folder(spark, path)
    if folder.has(job):
        return False
    name = folder.fresh("result")
    for label, write in results.items():
        write(f"{folder.path}/{name}/{label}")
    added = False

    def change(entries):
        nonlocal added
        known = {done for entry in entries for done in (entry["job"], *entry.get("jobs", ()))}
        added = job not in known
        if not added:
            return None
        entry = {"job": job, "folder": name}
        # An overwritten job stays known, so that its retry does not come back.
        return [*entries, entry] if mode == "append" else [entry | {"jobs": sorted(known)}]

    folder.commit(change)
    return added


def published(spark: SparkSession, path: str, label: str, fmt="text") -> DataFrame:
    """The rows of one label of all jobs that are committed and not overwritten."""
    folder = Folder(spark, path)
    paths = [f"{folder.path}/{entry['folder']}/{label}" for entry in folder.entries()]
    if not paths:
        raise ValueError(f"{path}: nothing is published")
    return spark.read.format(fmt).load(paths)
