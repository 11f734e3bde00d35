"""Publication of loads. A load is a list of pieces and becomes visible by one entry in the log.

A piece is a folder with rows of one table: the whole table, one part of it (a year, a bucket), or rows appended
to it. A load names all its pieces, and those that did not change are shared with the load before. A reader sees
the old set of pieces or the new one, never a mix, and a failed load leaves the old set current. Each
entry has a folder of its own, named by its number, so of two writers that follow the same load one fails.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.sources.tables import exists, together, write_parquet

_LOG = "versions"
_ENTRY = "table string, part string, path string, note string, folder string"
_LOAD = "load"


@dataclass(frozen=True)
class Piece:
    """Rows of ``table`` in the folder ``path`` under the root; ``part`` names what they replace, "" a whole table."""

    table: str
    part: str
    path: str


@dataclass
class Load:
    version: int
    folder: str
    pieces: list[Piece] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)

    def of(self, table: str) -> list[Piece]:
        return [p for p in self.pieces if p.table == table]

    def without(self, *tables: str) -> list[Piece]:
        return [p for p in self.pieces if p.table not in tables]


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all complete entries, newest first."""
    place, store = _path(spark, f"{root}/{_LOG}/*/_SUCCESS")
    return sorted((int(s.getPath().getParent().getName()) for s in store.globStatus(place) or []), reverse=True)


def _entry(spark: SparkSession, root: str, version: int) -> Load:
    rows = spark.read.schema(_ENTRY).json(f"{root}/{_LOG}/{version:012d}").collect()
    return Load(version, next(r.folder for r in rows if r.folder is not None),
                [Piece(r.table, r.part, r.path) for r in rows if r.path is not None],
                {r.part: r.note for r in rows if r.note is not None})


def current_load(spark: SparkSession, root: str) -> Load | None:
    """The newest complete load, or None before the first one."""
    found = _entries(spark, root) if exists(spark, f"{root}/{_LOG}") else []
    return _entry(spark, root, found[0]) if found else None


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, folder) of the newest complete load, or None before the first one."""
    load = current_load(spark, root)
    return (load.version, load.folder) if load else None


def new_folder(root: str) -> str:
    return f"{root}/load-{uuid.uuid4().hex}"


def enter(spark: SparkSession, root: str, folder: str, pieces: Iterable[Piece], notes: dict[str, object] | None = None,
          after: int | None = None) -> int:
    """Write the entry of a load; this is the moment it becomes visible.

    ``after`` is the version the load was made from (by default the newest one). If another load was entered after that
    one, this one fails.
    """
    if after is None:
        after = next(iter(_entries(spark, root) if exists(spark, f"{root}/{_LOG}") else []), 0)
    rows = [(None, None, None, None, folder)]
    rows += [(p.table, p.part, p.path, None, None) for p in pieces]
    rows += [(None, name, None, str(note), None) for name, note in (notes or {}).items()]
    line = spark.createDataFrame(rows, _ENTRY).coalesce(1)
    line.write.mode("error").json(f"{root}/{_LOG}/{after + 1:012d}")
    return after + 1


def drop_entry(spark: SparkSession, root: str, version: int) -> None:
    """Remove the entry of an old load, if there is one; its pieces stay for ``remove_old_loads``."""
    if version > 0:
        place, store = _path(spark, f"{root}/{_LOG}/{version:012d}")
        store.delete(place, True)


def _under(root: str, path: str) -> str:
    return path[len(root) + 1:] if path.startswith(f"{root}/") else path


def write_whole(df: DataFrame, root: str, folder: str, table: str) -> list[Piece]:
    """A table, or rows to append to it, as one piece in the folder of the load."""
    write_parquet(df, f"{folder}/{table}")
    return [Piece(table, "", _under(root, f"{folder}/{table}"))]


def write_parts(df: DataFrame, root: str, table: str, column: str) -> list[Piece]:
    """One piece per value of ``column``, all in the folder of the table, next to the pieces of other loads."""
    spark, load = df.sparkSession, f"l{uuid.uuid4().hex}"
    base = f"{root}/{table}"
    df.withColumn(_LOAD, F.lit(load)).write.mode("append").partitionBy(column, _LOAD).parquet(base)
    place, store = _path(spark, f"{base}/*/{_LOAD}={load}")
    names = [s.getPath().getParent().getName() for s in store.globStatus(place) or []]
    return [Piece(table, name.split("=", 1)[1], f"{table}/{name}/{_LOAD}={load}") for name in sorted(names)]


def read_pieces(spark: SparkSession, root: str, pieces: list[Piece], schema: T.StructType) -> DataFrame:
    """The rows of some pieces of one table; values of a part's column come from the names of the folders."""
    if not pieces:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if any(p.part for p in pieces):
        reader = reader.option("basePath", f"{root}/{pieces[0].table}")
    return reader.parquet(*[p.path if "://" in p.path or p.path.startswith("/") else f"{root}/{p.path}" for p in pieces]).select(*schema.names)


def publish(tables: dict[str, DataFrame], root: str,
            partition_by: dict[str, str] | None = None) -> str:
    """Write all tables anew, then make them current. Returns the folder of the load."""
    spark = next(iter(tables.values())).sparkSession
    folder = new_folder(root)

    def job(name: str, df: DataFrame) -> Callable[[], list[Piece]]:
        column = (partition_by or {}).get(name)
        return lambda: write_parts(df, root, name, column) if column else write_whole(df, root, folder, name)

    written = together(spark, {name: job(name, df) for name, df in tables.items()})
    enter(spark, root, folder, [p for own in written.values() for p in own])
    return folder


def remove_old_loads(spark: SparkSession, root: str, keep: int = 1, older_than: float = 86_400) -> list[str]:
    """Remove entries before the newest ``keep`` and all folders that none of those names. Returns what went.

    What was written in the last ``older_than`` seconds stays: it may belong to a load that is not entered yet.
    """
    found = _entries(spark, root) if exists(spark, f"{root}/{_LOG}") else []
    loads = [_entry(spark, root, v) for v in found[:keep]]
    named = {p.path for load in loads for p in load.pieces} | {_under(root, load.folder) for load in loads}
    limit, gone = (time.time() - older_than) * 1000, []

    def listed(pattern: str) -> list:
        place, store = _path(spark, f"{root}/{pattern}")
        return list(store.globStatus(place) or [])

    def remove(status) -> None:
        if status.getModificationTime() <= limit:
            place, store = _path(spark, status.getPath().toString())
            store.delete(place, True)
            gone.append(status.getPath().getName())

    for version in found[keep:]:
        for status in listed(f"{_LOG}/{version:012d}"):
            remove(status)
    for status in listed("load-*"):
        own = status.getPath().getName()
        if not any(name == own or name.startswith(f"{own}/") for name in named):
            remove(status)
    for status in listed(f"*/*/{_LOAD}=*"):
        path = status.getPath()
        if f"{path.getParent().getParent().getName()}/{path.getParent().getName()}/{path.getName()}" not in named:
            remove(status)
    return gone
