"""Results to tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.functions.models.roles import Embedding, with_embeddings
from semframe.sources.catalog import TableRegistry


def write_table(df: DataFrame, name: str, mode: str = "error", bucket_by: tuple[str, ...] = (), buckets: int = 0, sort_by: tuple[str, ...] = ()) -> None:
    """A managed table; bucketed by its join keys, later joins on them need no
    shuffle."""
    writer = df.write.mode(mode)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by)
        writer = writer.sortBy(*sort_by) if sort_by else writer
    writer.saveAsTable(name)


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error", header: bool = True) -> None:
    """Nested columns are written as JSON text."""
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(f"`{c}`") for c in df.columns]
    df.select(*flat).write.mode(mode).option("header", header).option("escape", "\"").csv(path)


def document_vectors(df: DataFrame, title: str, text: str, model: Embedding) -> DataFrame:
    """Documents with ``title_embedding`` and ``text_embedding``."""
    return with_embeddings(with_embeddings(df, title, "title_embedding", model), text, "text_embedding", model)


def table_name_vectors(registry: TableRegistry, model: Embedding) -> DataFrame:
    """``schemaname, tablename, embedding`` of the registered tables."""
    names = registry.names()
    rows = [(*n.split("."), [float(x) for x in v]) for n, v in zip(names, model(names))]
    return registry.spark.createDataFrame(rows, "schemaname string, tablename string, embedding array<float>")
