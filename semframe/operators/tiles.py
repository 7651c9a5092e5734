"""All pairs within blocks of any size, without a task that holds a whole block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(df: DataFrame, block: str, item: str, tile: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``block, item, other``: every pair of different items of one block, once
    for each pair of their rows, the smaller item first; ``carry`` names columns
    that come along, as ``x`` and ``other_x``.

    A block is cut into tiles of about ``tile`` rows, salted by the item, and
    each tile meets itself and every other tile of the block: nothing is left
    out, and no key of the join holds more than one tile a side.  ``df`` is read
    three times.
    """
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tiles = F.ceil(F.col("_n") / F.lit(tile)).cast("int")
    placed = df.select(block, item, *carry).join(sizes, block).withColumn("_of", tiles).withColumn("_tile", F.pmod(F.xxhash64(F.col(item), F.lit(1)), F.col("_of")).cast("int"))
    a = placed.select(block, item, *carry, F.col("_tile").alias("_i"), F.explode(F.sequence("_tile", F.col("_of") - 1)).alias("_j"))
    b = placed.select(block, F.col(item).alias("other"), *[F.col(c).alias(f"other_{c}") for c in carry], F.explode(F.sequence(F.lit(0), "_tile")).alias("_i"), F.col("_tile").alias("_j"))
    met = a.join(b, [block, "_i", "_j"]).where(f"`{item}` < other or _i < _j and `{item}` <> other")
    turned = F.col(item) > F.col("other")
    columns = [(item, "other"), *[(c, f"other_{c}") for c in carry]]
    return met.select(block, *[F.when(turned, F.col(y if one else x)).otherwise(F.col(x if one else y)).alias(x if one else y) for one in (True, False) for x, y in columns])
