"""Streams.  Select, project, union and the probe side of a hash join keep no
state, so they take streaming relations as they are; grouping a stream needs a
time window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semframe.functions.serialize import quoted
from semframe.operators.aggregate import Aggregation
from semframe.relation import Relation
from semframe.runtime import shared_dir


def stream_folder(spark: SparkSession, name: str, path: str, schema: T.StructType, form: str = "parquet", files_a_batch: int = 100) -> Relation:
    """Files that appear in a folder."""
    return Relation(spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path), name, (f"stream {path}", ()))


def windowed_aggregate(relation: Relation, time: str, width: str, late: str, keys: list[str], aggregations: list[Aggregation], slide: str | None = None) -> Relation:
    """Groups of keys in tumbling or sliding windows.  Rows later than ``late``
    behind the newest are dropped by a stream; a batch keeps all.  A stream's
    times become timestamps of the session's zone."""
    rows = relation.df.withColumn(time, quoted(time).cast("timestamp")) if relation.df.isStreaming else relation.df
    rows = rows.withWatermark(time, late) if relation.df.isStreaming else rows
    window = F.window(quoted(time), width, slide) if slide else F.window(quoted(time), width)
    df = rows.groupBy(window.alias("w"), *[quoted(k) for k in keys]).agg(*[a.column().alias(a.output) for a in aggregations])
    df = df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[quoted(k) for k in keys], *[quoted(a.output) for a in aggregations])
    return relation.derive(df, f"window [{time}, {width}; {', '.join(keys)}]")


def session_aggregate(relation: Relation, time: str, gap: str, late: str, keys: list[str], aggregations: list[Aggregation]) -> Relation:
    """Groups of keys in sessions that end when nothing comes for ``gap``; of a
    stream, with a watermark as in ``windowed_aggregate``."""
    rows = relation.df.withColumn(time, quoted(time).cast("timestamp")).withWatermark(time, late) if relation.df.isStreaming else relation.df
    df = rows.groupBy(F.session_window(quoted(time), gap).alias("w"), *[quoted(k) for k in keys]).agg(*[a.column().alias(a.output) for a in aggregations])
    df = df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[quoted(k) for k in keys], *[quoted(a.output) for a in aggregations])
    return relation.derive(df, f"session [{time}, {gap}; {', '.join(keys)}]")


def run_available(relation: Relation, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a Parquet folder with
    exactly-once files, and read the result."""
    spark = relation.df.sparkSession
    from uuid import uuid4

    kept = checkpoint or f"{shared_dir(spark)}/semframe/stream-{uuid4().hex}"
    query = relation.df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", kept).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(relation.df.schema).parquet(path)
