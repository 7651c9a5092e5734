"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset
    (local tests) a temporary folder is made once and put into the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.semframe.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="semframe-")
        spark.conf.set("spark.semframe.shared.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables staged so far in the shared folder.  Results that are
    not read yet need theirs, so this is for when they are written or shown."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/semframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
