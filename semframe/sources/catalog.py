"""Tables by name, with keys and sample values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUALIFIED = re.compile(r"\w+\.\w+")


@dataclass
class TableRegistry:
    """``schema.table`` to DataFrame.  Keys live in the metadata of the fields."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, primary_key: tuple[str, ...] = (), foreign_keys: dict[str, str] | None = None) -> None:
        """``foreign_keys`` maps a column to ``schema.table.column``."""
        if not QUALIFIED.fullmatch(name):
            raise ValueError(f"{name} isn't schema.table")
        if len(set(df.columns)) < len(df.columns):
            raise ValueError(f"{name} has a column twice")
        notes = {c: {"primary_key": c in primary_key} | ({"references": foreign_keys[c]} if foreign_keys and c in foreign_keys else {}) for c in {*primary_key, *(foreign_keys or {})}}
        self.tables[name] = _noted(df, notes)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, names: list[str], schema: str = "public") -> TableRegistry:
        """Parquet tables ``<folder>/<name>.parquet``."""
        out = cls(spark)
        for name in names:
            out.register(f"{schema}.{name}", spark.read.parquet(f"{folder}/{name}.parquet"))
        return out

    @classmethod
    def from_catalog(cls, spark: SparkSession) -> TableRegistry:
        """All tables of the session catalog's databases."""
        out = cls(spark)
        for base in spark.catalog.listDatabases():
            for t in spark.catalog.listTables(base.name):
                if not t.isTemporary:
                    out.register(f"{base.name}.{t.name}", spark.table(f"`{base.name}`.`{t.name}`"))
        return out

    def names(self) -> list[str]:
        return list(self.tables)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def columns(self, name: str) -> list[T.StructField]:
        return list(self.tables[name].schema.fields)

    def samples(self, name: str, column: str, n: int = 10, share: float = 0.01, seed: int = 7) -> list:
        """Up to ``n`` distinct values of a sampled column, for prompts; none of
        nested columns."""
        kind = self.tables[name].schema[column].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)):
            return []
        return [r[0] for r in self.tables[name].select(column).sample(share, seed).distinct().limit(n).collect()]


def _noted(df: DataFrame, notes: dict[str, dict]) -> DataFrame:
    for column, note in notes.items():
        df = df.withMetadata(column, note)
    return df
