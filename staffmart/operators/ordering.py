"""Row positions and row neighbours over a total order, without a one-task window.

Rows are range-partitioned on the full order, so a key that holds a third of the table is
spread over many partitions. Each partition is one chunk. Work inside a chunk is an ordinary
window; what crosses a chunk border needs one small row per chunk, whose number is the
number of shuffle partitions and does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from staffmart.sources.tables import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def sorted_chunks(df: DataFrame, order: list[Column | str], label: str = "sorted") -> DataFrame:
    """``df`` in the given order with ``_chunk`` and ``_row``, written to the shared folder.

    The order must be total (end with a unique column). Chunks ascend with the order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.select(
        "*",
        F.spark_partition_id().alias("_chunk"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"))
    return materialise(placed, label)


def _over_chunks() -> WindowSpec:
    """Order over all chunks: one row per shuffle partition, so one task is enough."""
    return Window.partitionBy(F.lit(0)).orderBy("_chunk")


def _rows_before(chunks: DataFrame) -> DataFrame:
    """One row per chunk, with the number of rows in all chunks before it."""
    sizes = chunks.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size"))
    earlier = _over_chunks().rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))


def closed_up(chunks: DataFrame, label: str = "kept") -> DataFrame:
    """Chunks after a filter, with ``_row`` counted anew, written to the shared folder."""
    row = F.row_number().over(Window.partitionBy("_chunk").orderBy("_row")) - 1
    return materialise(chunks.withColumn("_row", row.cast("long")), label)


def number_chunks(chunks: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Dense numbers from ``start`` in chunk order, for sorted or closed-up chunks."""
    offsets = _rows_before(chunks).select("_chunk", "_before")
    return (chunks.join(F.broadcast(offsets), "_chunk")
            .withColumn(name, F.col("_before") + F.col("_row") + start)
            .drop("_before"))


def with_position(df: DataFrame, name: str, order: list[Column | str], start: int = 1) -> DataFrame:
    """Dense number of each row in a total order: 1, 2, 3, … over the whole table."""
    chunks = sorted_chunks(df, order, name)
    return number_chunks(chunks, name, start).select(name, *df.columns)


def _across_chunks(chunks: DataFrame, key: str, column: str, forward: bool) -> DataFrame:
    """Per chunk, the key and value of the nearest row in another chunk."""
    edge = F.min if forward else F.max
    edges = chunks.groupBy("_chunk").agg(edge(F.struct("_row", key, column)).alias("_edge"))
    near = (F.lead if forward else F.lag)("_edge").over(_over_chunks())
    return (edges.select("_chunk", near.alias("_near"))
            .select("_chunk", F.col(f"_near.{key}").alias("_near_key"),
                    F.col(f"_near.{column}").alias("_near_value")))


def _with_neighbour(chunks: DataFrame, key: str, column: str, name: str, forward: bool) -> DataFrame:
    within = Window.partitionBy("_chunk").orderBy("_row")
    step = F.lead if forward else F.lag
    border = _across_chunks(chunks, key, column, forward)
    inside = (chunks
              .withColumn("_next_key", step(key).over(within))
              .withColumn("_next_value", step(column).over(within))
              .withColumn("_is_edge", step(F.lit(False), 1, True).over(within)))
    found_key = F.when(F.col("_is_edge"), F.col("_near_key")).otherwise(F.col("_next_key"))
    found = F.when(F.col("_is_edge"), F.col("_near_value")).otherwise(F.col("_next_value"))
    return (inside.join(F.broadcast(border), "_chunk", "left")
            .withColumn(name, F.when(found_key == F.col(key), found))
            .drop("_next_key", "_next_value", "_is_edge", "_near_key", "_near_value"))


def with_previous(chunks: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """``column`` of the row before, if it has the same key; else NULL."""
    return _with_neighbour(chunks, key, column, name, forward=False)


def with_next(chunks: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """``column`` of the row after, if it has the same key; else NULL."""
    return _with_neighbour(chunks, key, column, name, forward=True)


def tile_of(position: Column, rows: int, tiles: int) -> Column:
    """Tile of the row at a position from 1; the first (rows mod tiles) tiles have one row more."""
    small, larger = divmod(rows, tiles)
    before = position - 1
    in_larger = larger * (small + 1)
    tile = F.floor(before / F.lit(small + 1)) + 1
    if small:
        tile = F.when(before < in_larger, tile).otherwise(F.floor((before - in_larger) / F.lit(small)) + larger + 1)
    return tile.cast("int")


def rows_in_tiles(rows: Column, tiles: int, first: int, last: int) -> Column:
    """Rows in the tiles from ``first`` to ``last``, both included."""
    small, larger = F.floor(rows / tiles), rows % tiles
    return (small * (last - first + 1) + F.greatest(F.lit(0), F.least(larger, F.lit(last)) - (first - 1))).cast("long")


def with_tile(df: DataFrame, name: str, tiles: int, order: list[Column | str]) -> DataFrame:
    """NTILE over the whole table."""
    chunks = sorted_chunks(df, order, name)
    placed = number_chunks(chunks, "_position")
    return placed.withColumn(name, tile_of(F.col("_position"), chunks.count(), tiles)).select(*df.columns, name)


def with_tile_of_levels(df: DataFrame, name: str, tiles: int, level: str, key: str) -> DataFrame:
    """NTILE over the whole table by a falling ``level`` that has few different values, ties by ``key``.

    ``df`` should be a written table; it is read three times. Rows are counted per level, and the places of a level follow from the
    counts above it. Only rows of a level that a border between tiles runs through (fewer than there are tiles) are sorted, by key. The
    counts are one row per level, go through one task, and are broadcast: use this where levels are bounded by their kind, such as
    scores of two decimals.
    """
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc(level))
    counts = materialise(df.groupBy(level).agg(F.count(F.lit(1)).alias("_n")), "levels")
    rows = counts.agg(F.sum("_n").alias("n")).first().n or 0
    before = F.coalesce(F.sum("_n").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = counts.select(level, "_n", before.alias("_before")).select(
        level, "_before", "_n", tile_of(F.col("_before") + 1, rows, tiles).alias("_first"),
        tile_of(F.col("_before") + F.col("_n"), rows, tiles).alias("_last"))
    split = F.when(F.col("_first") != F.col("_last"), F.col("_n")).otherwise(0)
    sorted_before = F.coalesce(F.sum(split).over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = materialise(levels.withColumn("_sorted_before", sorted_before), "levels")
    clear = levels.where("_first = _last").select(level, F.col("_first").alias(name))
    whole = df.join(F.broadcast(clear), level).select(*df.columns, name)
    cut = levels.where("_first <> _last").select(level, (F.col("_before") - F.col("_sorted_before")).alias("_shift"))
    if cut.isEmpty():
        return whole
    tied = with_position(df.join(F.broadcast(cut), level), "_position", [F.desc(level), key])
    tied = tied.withColumn(name, tile_of(F.col("_position") + F.col("_shift"), rows, tiles))
    return whole.unionByName(tied.select(*df.columns, name))
