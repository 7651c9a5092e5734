"""Relations from inline rows, tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from semframe.functions.models.roles import Embedding, Validator
from semframe.operators.binding import ranked
from semframe.relation import Relation
from semframe.sources.catalog import QUALIFIED, TableRegistry


def values(spark: SparkSession, name: str, columns: list[str], rows: list[dict | tuple], schema: T.StructType | str | None = None) -> Relation:
    """Inline rows: tuples by position, dicts by name (missing ones are null).

    Types come from all rows; empty rows need a schema.  A column named twice
    is refused."""
    if len(set(columns)) < len(columns):
        raise ValueError(f"relation {name} has a column twice")
    told = [tuple(r.get(c) for c in columns) if isinstance(r, dict) else tuple(r) for r in rows]
    for r in told:
        if len(r) != len(columns):
            raise ValueError(f"a row of {name} has {len(r)} values for {len(columns)} columns")
    if schema is None and not told:
        raise ValueError(f"relation {name} is empty and needs a schema")
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return Relation(spark.createDataFrame(told, schema or columns), name, (f"values {name}({', '.join(columns)})", ()))


def resolve_table(registry: TableRegistry, name: str, semantic: bool = True, model: Embedding | None = None, threshold: float = 0.8, validator: Validator | None = None) -> str:
    """The registered name that a name stands for.

    Exact names (``schema.table``) are looked up.  Otherwise the name is
    embedded with every registered name; of those above the threshold the best
    is taken, or the best to which the validator says yes."""
    if not semantic:
        if not QUALIFIED.fullmatch(name):
            raise ValueError(f"{name} isn't schema.table")
        if name not in registry.tables:
            raise KeyError(f"no table {name}")
        return name
    if model is None:
        raise ValueError("binding by meaning needs an embedding model")
    for found in ranked(name, registry.names(), model, threshold):
        if validator is None or validator(f'A table is called "{found}". Is it the one somebody wants who asks for "{name}"? Yes or no.'):
            return found
    raise KeyError(f"no table means {name}")


def scan(registry: TableRegistry, name: str, semantic: bool = True, model: Embedding | None = None, threshold: float = 0.8, validator: Validator | None = None, annex: str | None = None, limit: int | None = None) -> Relation:
    """A registered table, bound exactly or by meaning.

    ``annex`` is SQL behind ``SELECT * FROM table`` (WHERE, ORDER BY, ...), so
    its filters reach the file scan; ``limit`` follows it."""
    found = resolve_table(registry, name, semantic, model, threshold, validator)
    df = registry.table(found)
    if annex:
        df = registry.spark.sql(f"SELECT * FROM {{t}} {annex}", t=df)
    if limit is not None:
        df = df.limit(int(limit))
    text = f"scan {found}" + (f" {annex}" if annex else "") + (f" limit {limit}" if limit is not None else "")
    return Relation(df, found.partition(".")[2], (text, ()))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, index_column: str | None = None, separator: str = ",") -> DataFrame:
    """CSV or TSV, also compressed (gz, bz2); ``index_column`` names a first
    column without a header.  Without a schema everything is text."""
    reader = spark.read.option("header", header).option("sep", separator).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumnRenamed("_c0", index_column) if index_column and "_c0" in df.columns else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A whole file of one array or object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, nested_as_text: tuple[str, ...] = (), schema: T.StructType | str | None = None) -> DataFrame:
    """One record a line; the named fields keep their JSON as text."""
    from pyspark.sql import functions as F

    if nested_as_text:
        raw = spark.read.text(path)
        told = spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
        cells = [F.get_json_object("value", f"$.{f.name}").alias(f.name) if f.name in nested_as_text else F.from_json("value", T.StructType([f]))[f.name].alias(f.name) for f in told.schema.fields]
        return raw.select(*cells)
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """``title, revision_id, text`` of each page of a MediaWiki dump, also
    compressed; the file is split at pages and read in parallel."""
    page = T._parse_datatype_string("title string, revision struct<id: bigint, text: struct<_VALUE: string>>")
    df = spark.read.format("xml").option("rowTag", "page").schema(page).load(path)
    return df.selectExpr("title", "revision.id as revision_id", "revision.text._VALUE as text")


def read_jdbc(spark: SparkSession, url: str, query_or_table: str, properties: dict[str, str] | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int | None = None) -> DataFrame:
    """A table of a database, in parallel ranges of a column where given; the
    driver's jar must be on the class path."""
    extra = {"column": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts} if partition_column and bounds and parts else {}
    return spark.read.jdbc(url, query_or_table, properties=properties or {}, **extra)
