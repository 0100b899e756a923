"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def builder(app: str = "trendloom") -> SparkSession.Builder:
    """A session builder with adaptive execution, UTC, and splits sized for text work."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "64m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints, shared by all executors.

    It lies in the folder named by spark.checkpoint.dir or, where that is unset, in the warehouse.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    system, path = _folder(spark, path)
    return system.exists(path)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=number`` in a folder, in order."""
    system, pattern = _folder(spark, f"{path}/{name}=*")
    return sorted(int(found.getPath().getName().split("=")[1]) for found in system.globStatus(pattern) or [])


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds."""
    system, path = _folder(spark, path)
    system.delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for made in tables:
        for file in made.inputFiles()[:1]:
            delete_folder(made.sparkSession, file.rsplit("/", 1)[0])


def written(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The same rows read back from a written table: lineage ends here and survives executors."""
    path = work_folder(df.sparkSession, purpose)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored bytes of posts for one task: their terms take some fifty times as many in memory.
TASK_BYTES = 4 << 20
#: The most of them where terms are grouped: small groupings stay near the processor and far from spilling.
GATHER_BYTES = 2 << 20


def tasks_for(df: DataFrame, most: int | None = None) -> int | None:
    """Number of tasks for rows that come from files, in proportion to the bytes of these, at least one a core.

    A fixed number would give each task ever more rows, which it then sorts and spills. None if the rows
    come from no files, so that nothing is known of their number. ``most`` bounds the bytes of a task further.
    """
    spark = df.sparkSession
    uri = spark._jvm.java.net.URI  # names of input files are encoded
    sizes = [system.getFileStatus(path).getLen() for system, path in (_folder(spark, uri(f)) for f in df.inputFiles())]
    task_bytes = min(TASK_BYTES, most or TASK_BYTES)
    return max(spark.sparkContext.defaultParallelism, -(-sum(sizes) // task_bytes)) if sizes else None


def batch_tasks(df: DataFrame, most: int) -> int:
    """As ``tasks_for`` for a micro-batch, whose files Spark doesn't tell: as if each of its splits were full."""
    spark = df.sparkSession
    full = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(spark.sparkContext.defaultParallelism, -(-df._jdf.rdd().getNumPartitions() * full // most))


def gathered(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """All rows of a key in one task, in so many tasks; as they are if the number is not known."""
    return df.repartition(tasks, *by) if tasks else df


MAX_BROADCAST_ROWS = 500_000


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast narrow rows whose number is proven to be at most max_rows, if that is small.

    Beyond the limit the choice is left to Spark, which shuffles what it cannot broadcast.
    """
    return F.broadcast(df) if max_rows <= MAX_BROADCAST_ROWS else df
