"""Session settings and the shared folder for written intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables that `written` made.
_WRITTEN = []


def build_session(app_name="termscale", master=None, shuffle_partitions=None, **conf):
    """A session with the settings the jobs are written for; everything else is the cluster's.

    On a cluster leave `shuffle_partitions` high (input bytes / 200 MB is a good start): AQE
    merges what turns out too small.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session may go without it; there a temporary folder is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="termscale-"))
    return context.getCheckpointDir()


def written(df: DataFrame, label: str, by=()) -> DataFrame:
    """`df` as a Parquet table in the shared folder, with a folder for each value of the columns `by`.

    For results with several consumers: the work is done once, survives the loss of executors,
    holds no executor memory, and each consumer reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Remove the tables that `written` made in this process; nothing may be read from them afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _WRITTEN:
        path = hadoop.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
