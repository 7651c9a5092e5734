"""Deeply nested JSON records as related flat tables.

Everything stays on the JVM: the text is parsed once into a variant, and one
``variant_explode`` a nesting level turns arrays and objects into child rows
that carry the surrogate key of their parent and their ordinal.  No step
shuffles; every few levels the rows are written to the shared folder, so the
plan does not grow with the depth of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from semframe.runtime import staged


def readable(text: Column, unwraps: int = 3) -> Column:
    """The JSON value of a text, or null where it can't be read.

    A JSON string that itself holds JSON is unwrapped, up to ``unwraps`` times
    (``nested_nodes`` goes on as long as there are any); a string that holds
    none stays a string."""
    value = F.try_parse_json(text)
    if not unwraps:
        return value
    inner = readable(F.try_variant_get(value, "$", "string"), unwraps - 1)
    return F.when(F.rlike(text, F.lit(r'^\s*"')) & inner.isNotNull(), inner).otherwise(value)


def is_string(value: Column) -> Column:
    return F.to_json(value).startswith('"')


def exploded(df: DataFrame, value: str = "v") -> DataFrame:
    """One row for each element or field of ``value``, as ``pos, key, value``;
    scalars and nulls have none."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()))


def unwrapped(df: DataFrame, value: str = "v", wrapped: str = "wrapped", most: int = 64) -> DataFrame:
    """Rows whose value is a string that holds JSON get what it holds, until
    none does; each round parses three wraps more.  Only rows that are marked
    as wrapped are looked at."""
    for _ in range(most):
        again = df.withColumn("_inner", F.when(F.col(wrapped) & is_string(F.col(value)), readable(F.try_variant_get(value, "$", "string"))))
        if not again.where(F.col(wrapped) & F.col("_inner").isNotNull()).limit(1).count():
            return df.drop(wrapped)
        df = staged(again.withColumn(value, F.coalesce("_inner", value)).drop("_inner"), "unwrapped")
    raise ValueError("text is wrapped without end")


def nested_nodes(df: DataFrame, record: str, columns: str | list[str], id_field: str = "id", levels_a_stage: int = 2, max_depth: int = 256) -> DataFrame:
    """All nested objects, arrays and values of one or more JSON columns, one
    row each.

    Returns ``source, record_id, row, node, parent_node, prop, ordinal, parent_id,
    child_id, v``: ``source`` is the column, ``node`` the surrogate key (the
    row's number, the column and the path of fields and ordinals),
    ``parent_node`` that of the enclosing object, ``ordinal`` the position in
    the enclosing array or object, ``prop`` the nearest enclosing field,
    ``child_id`` the object's own ``id_field`` and ``parent_id`` that of the
    nearest enclosing object that has one, else the record.  ``v`` is the value.
    All columns go down together, ``levels_a_stage`` levels a written table.

    Defined results: null, empty or broken text and JSON null give no node;
    wrapped JSON is unwrapped, however often; an array and a single object in
    its place are treated alike; each delivery of a record has its own surrogate
    keys; other columns are ignored; an empty table gives an empty result; more
    than ``max_depth`` levels are refused.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(f"`{c}`").alias("text")) for c in names])).alias("cell")
    top = df.select(F.col(f"`{record}`").cast("string").alias("record_id"), F.monotonically_increasing_id().alias("row"), cells)
    top = top.select("cell.source", "record_id", "row", readable(F.col("cell.text")).alias("v"), F.rlike("cell.text", F.lit(r'^\s*"')).alias("wrapped")).where("v is not null")
    now = top.select("source", "record_id", "row", F.concat_ws(":", "row", "source").alias("node"), F.lit(None).cast("string").alias("parent_node"), F.lit(None).cast("string").alias("prop"), F.lit(0).alias("ordinal"), F.col("record_id").alias("parent_id"), "v", "wrapped")
    own = F.try_variant_get("v", f"$.{id_field}", "string").alias("child_id")

    def told(level: DataFrame) -> DataFrame:
        return level.select(*[c for c in level.columns if c != "v"], own, "v")

    now = told(unwrapped(staged(now, "nested")))
    out = None
    for _ in range(0, max_depth, levels_a_stage):
        levels = [now]
        for _ in range(levels_a_stage):
            inner = exploded(levels[-1]).where("value is not null and (key is null or key <> '{}')".format(id_field.replace("'", "''")))
            # an array stands for its elements: they keep its enclosing object
            in_array = F.col("key").isNull()
            levels.append(told(inner.select("source", "record_id", "row", F.concat_ws("/", "node", F.coalesce(F.col("key"), F.col("pos").cast("string"))).alias("node"), F.when(in_array, F.col("parent_node")).otherwise(F.col("node")).alias("parent_node"), F.coalesce("key", "prop").alias("prop"), F.col("pos").alias("ordinal"), F.coalesce("child_id", "parent_id").alias("parent_id"), F.col("value").alias("v"))))
        for level in levels[:-1]:
            out = level if out is None else out.union(level)
        seen = Observation()  # counts while it is written
        now = staged(levels[-1].observe(seen, F.count(F.lit(1)).alias("n")), "nested")
        if not seen.get["n"]:
            return out
    raise ValueError(f"{', '.join(names)} nested deeper than {max_depth} levels")


def nested_objects(nodes: DataFrame) -> DataFrame:
    """The nodes that are objects with a non-null id."""
    return nodes.where("child_id is not null and prop is not null")


def nested_strings(nodes: DataFrame) -> DataFrame:
    """The nodes that are strings, with the string as ``child_id``."""
    return nodes.where(is_string(F.col("v"))).withColumn("child_id", F.try_variant_get("v", "$", "string"))


def merged_schema(nodes: DataFrame) -> DataFrame:
    """``prop, field, kind, objects``: the fields of the objects of each
    property, the merged type of their values and how many objects have them.
    ``prop`` is null for objects that stand in no property."""
    objects = nodes.where(F.to_json("v").startswith("{"))
    return exploded(objects.select("prop", "node", "v")).groupBy("prop", F.col("key").alias("field")).agg(F.schema_of_variant_agg("value").alias("kind"), F.count(F.lit(1)).alias("objects"))


PLAIN = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}


def table_rows(nodes: DataFrame) -> DataFrame:
    """The nodes that are rows of the flat tables: all objects, and the plain
    values of a record's own text, which stand in no object."""
    text = F.to_json("v")
    alone = F.col("prop").isNull() & ~text.startswith("[") & ~F.is_variant_null("v")
    return nodes.where(text.startswith("{") | alone)


def as_map(value: Column) -> Column:
    """The fields of an object; null for other values."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def flat_table(rows: DataFrame, prop: str | None, known: dict[str, str] | None) -> DataFrame:
    """The rows of one property with a column for each of the ``known`` fields,
    or, where these are None, with all fields in one map ``_fields``."""
    columns = [] if prop is not None else [F.when(~F.to_json("v").startswith("{"), F.to_json("v")).alias("_value")]
    if known is None:
        columns.append(F.transform_values(as_map(F.col("v")), lambda _, x: F.to_json(x)).alias("_fields"))
    for name, kind in sorted((known or {}).items()):
        # a path can't hold an apostrophe
        at, path = (F.col("v"), f"$['{name}']") if "'" not in name else (F.try_element_at(as_map(F.col("v")), F.lit(name)), "$")
        cell = F.try_variant_get(at, path, PLAIN.get(kind, "variant"))
        columns.append((cell if kind in PLAIN else F.to_json(cell)).alias(name))
    return rows.where(F.col("prop").eqNullSafe(F.lit(prop))).select("record_id", F.col("node").alias("_node"), F.col("parent_node").alias("_parent_node"), F.col("ordinal").alias("_ordinal"), *columns)


def child_table(nodes: DataFrame, prop: str | None, max_fields: int = 2000) -> DataFrame:
    """The flat table of one property: surrogate, parent, ordinal and one
    column for each field of the merged schema of its objects.

    Fields whose values vary in shape keep their JSON text; nested objects have
    tables of their own, linked by ``parent_node``.  ``prop`` None is the table
    of the records' own objects, with other values that stand in no object as
    JSON text in ``_value``.  More than ``max_fields`` fields (names made from
    data) are refused; ``child_tables`` has them as a map, ``merged_schema``
    shows them.
    """
    rows = table_rows(nodes).where(F.col("prop").eqNullSafe(F.lit(prop)))
    known = {r.field: r.kind for r in merged_schema(rows).select("field", "kind").limit(max_fields + 1).collect()}  # one row a field name
    if len(known) > max_fields:
        raise ValueError(f"{prop} has more than {max_fields} fields")
    return flat_table(rows, prop, known)


class ChildTables(Mapping):
    """Flat tables by property, however many: the nodes are read and their
    schema merged once, names come from a written table, and a table is planned
    when it is asked for."""

    def __init__(self, nodes: DataFrame, max_fields: int):
        self.rows = staged(table_rows(nodes), "objects")
        self.kinds = staged(merged_schema(self.rows), "kinds")
        self.names = staged(self.rows.select("prop").distinct(), "names")
        self.max_fields = max_fields

    def __getitem__(self, prop: str | None) -> DataFrame:
        mine = F.col("prop").eqNullSafe(F.lit(prop))
        known = {r.field: r.kind for r in self.kinds.where(mine).select("field", "kind").limit(self.max_fields + 1).collect()}
        if not known and not self.names.where(mine).limit(1).count():
            raise KeyError(prop)
        return flat_table(self.rows, prop, known if len(known) <= self.max_fields else None)

    def __iter__(self) -> Iterator[str | None]:
        return (r.prop for r in self.names.orderBy("prop").toLocalIterator())

    def __len__(self) -> int:
        return self.names.count()


def child_tables(nodes: DataFrame, max_fields: int = 2000) -> ChildTables:
    """The flat tables of all properties whose values are objects, and under
    None that of the records themselves, to which the others' topmost
    ``_parent_node`` leads.  A property with more than ``max_fields`` fields has
    them as JSON text in one map column ``_fields``.  To have all rows at once
    use ``child_cells``, which doesn't read the nodes again for each table."""
    return ChildTables(nodes, max_fields)


def child_cells(nodes: DataFrame, most_fields: int = 1000) -> DataFrame:
    """The rows of all flat tables in one: ``prop, record_id, node, parent_node,
    ordinal, cells``, the cells as one JSON object by the merged schema of the
    property, and plain values of the records' own text as they are.

    Properties of up to ``most_fields`` fields meet their schema as one map, so
    no row is shuffled while the schemas are small; the fields of wider ones are
    joined one by one.
    """
    rows = staged(table_rows(nodes), "objects")
    kinds = staged(merged_schema(rows), "kinds")
    keys = ["prop", "record_id", "node", "parent_node", "ordinal"]

    def typed(value: Column, kind: Column) -> Column:
        plain = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint").cast("variant")).when(kind == "DOUBLE", F.try_variant_get(value, "$", "double").cast("variant")).when(~F.is_variant_null(value), value)
        return F.when(kind.isin(*PLAIN), plain).otherwise(F.to_json(value).cast("variant"))

    def as_json(cells: Column) -> Column:
        return F.to_json(F.map_from_entries(F.filter(cells, lambda c: c.value.isNotNull())))

    sizes = kinds.groupBy(F.col("prop").alias("_prop")).agg(F.count(F.lit(1)).alias("_size"))
    of_prop = F.col("prop").eqNullSafe(F.col("_prop"))
    is_object = F.to_json("v").startswith("{")
    # staged, so that the planner knows their size and sends them if it is small
    small = staged(kinds.join(sizes.where(F.col("_size") <= most_fields), of_prop).groupBy("_prop").agg(F.map_from_entries(F.collect_list(F.struct("field", "kind"))).alias("_kinds")), "kinds")
    wide = sizes.where(F.col("_size") > most_fields).select("_prop")
    some_wide = wide.limit(1).count() > 0
    cells = F.transform(F.map_entries(as_map(F.col("v"))), lambda e: F.struct(e.key.alias("key"), typed(e.value, F.try_element_at(F.col("_kinds"), e.key)).alias("value")))
    in_small = rows.join(wide, of_prop & is_object, "left_anti") if some_wide else rows
    out = in_small.join(small, of_prop, "left").select(*keys, F.when(is_object, as_json(cells)).otherwise(F.to_json("v")).alias("cells"))
    if some_wide:
        # the number of a row, since a path in which a field's name has a slash can stand twice
        wide_rows = rows.join(wide, of_prop & is_object, "left_semi").withColumn("_row", F.monotonically_increasing_id())
        parts = wide_rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select("_row", *keys, "key", "value")
        told = parts.join(kinds.select(F.col("prop").alias("_prop"), "field", "kind"), of_prop & (F.col("key") == F.col("field")), "left")
        cell = F.when(F.col("key").isNotNull(), F.struct("key", typed(F.col("value"), F.col("kind")).alias("value")))
        out = out.union(told.groupBy("_row", *keys).agg(as_json(F.collect_list(cell)).alias("cells")).select(*keys, "cells"))
    return out
