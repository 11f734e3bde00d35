"""Which version of an employee was valid on a date."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffmart.functions.dates import open_end
from staffmart.sources.tables import materialise

# Tasks get these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def versions_on(dim_employee: DataFrame, date) -> DataFrame:
    """All versions valid on one date, both ends included."""
    return dim_employee.where(F.lit(str(date)).cast("date").between(F.col("start_date"), F.col("end_date")))


def version_counts(dim_employee: DataFrame, more_than: int = 1) -> DataFrame:
    """Employees with more than the given number of versions."""
    return (dim_employee.groupBy("employee_id").agg(F.count(F.lit(1)).alias("versions"))
            .where(F.col("versions") > more_than))


# An employee with more versions than this is gone through in cells of so many days, each on its own.
MOST_VERSIONS, CELL_DAYS = 10_000, 32
_SPAN = ["employee_id", "start_date", "end_date", "employee_sk", "department_sk"]


def validity_segments(dim_employee: DataFrame, most_versions: int = MOST_VERSIONS, cell_days: int = CELL_DAYS) -> DataFrame:
    """Days (first_day to last_day) per employee that do not overlap, with the valid version.

    Where versions overlap the newest start wins, and on equal starts the highest key. A
    date then matches at most one segment, so reviews are joined once and need no ranking
    per review. All work here is on the dimension, and its result is a written table.

    A version that starts no earlier than all before it have ended is just cut where the
    next one starts. Employees with real overlaps have their versions gone through once, in order
    of their starts. Work grows with the number of versions, and there are at most two segments for each.
    The versions of an employee with more than ``most_versions`` are dealt to cells of ``cell_days`` days, so
    they span many tasks; a segment may then be cut at a cell's border.
    """
    spans = (dim_employee.where("start_date <= end_date")
             .groupBy("employee_id", "start_date", "end_date")
             .agg(F.max("employee_sk").alias("employee_sk"),
                  F.max_by("department_sk", "employee_sk").alias("department_sk")))
    spans = materialise(spans.select(*_SPAN), "versions")
    many = spans.groupBy("employee_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_versions).select("employee_id")
    many = materialise(many, "many-versions")
    hot = None
    if not many.isEmpty():
        hot = _swept(_in_cells(spans.join(many, "employee_id", "left_semi"), cell_days))
        spans = spans.join(many, "employee_id", "left_anti")
    in_order = Window.partitionBy("employee_id").orderBy("start_date", "employee_sk")
    ended = F.max("end_date").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = materialise(spans.select(
        "*", F.lead("start_date").over(in_order).alias("_next"),
        F.coalesce(ended > F.col("start_date"), F.lit(False)).alias("_overlaps")), "spans")
    overlapping = spans.where("_overlaps").select("employee_id").distinct()
    if overlapping.isEmpty():
        out = _cut_at_next(spans)
    else:
        overlapping = materialise(overlapping, "overlapping")
        out = _cut_at_next(spans.join(overlapping, "employee_id", "left_anti")).unionByName(
            _swept(_in_one_cell(spans.join(overlapping, "employee_id", "left_semi"))))
    return materialise(out if hot is None else out.unionByName(hot), "segments")


def _in_one_cell(spans: DataFrame) -> DataFrame:
    start, end = F.unix_date("start_date"), F.unix_date("end_date")
    return spans.select("employee_id", F.lit(0).alias("cell"), start.alias("order"), start.alias("first"), end.alias("last"),
                        "employee_sk", "department_sk")


def _in_cells(spans: DataFrame, cell_days: int) -> DataFrame:
    """The versions each cell of days needs, cut to the cell, with their start as order.

    A version is needed where it starts and where it ends. In the cells between it matters only if no newer one
    covers them whole: it is entered in the nodes of a tree over the cells, two per level at most, a node keeps its newest
    version, and a cell takes the newest of the nodes above it. After the last cell comes one for all days to the open end.
    """
    never = F.unix_date(open_end())
    rows = spans.select("employee_id", F.unix_date("start_date").alias("order"), F.unix_date("end_date").alias("end"),
                        F.struct(F.unix_date("start_date").alias("order"), "employee_sk", "department_sk").alias("version"))
    bounds = rows.select(F.min("order").alias("low"), F.max(F.greatest(
        "order", F.when(F.col("end") < never, F.col("end")).otherwise(F.col("order")))).alias("high")).first()
    low, tail = bounds.low, (bounds.high - bounds.low) // cell_days + 1  # the cell after the last border
    levels = tail.bit_length()
    begin = lambda cell: F.lit(low) + cell * cell_days
    stop = lambda cell: F.when(cell < tail, begin(cell + 1) - 1).otherwise(never)
    rows = rows.select("*", ((F.col("order") - low) / cell_days).cast("int").alias("from"),
                       F.when(F.col("end") >= never, tail + 1).otherwise(((F.col("end") - low) / cell_days).cast("int")).alias("to"))
    starting = rows.select("employee_id", F.col("from").alias("cell"), "version", F.col("order").alias("first"),
                           F.least("end", stop(F.col("from"))).alias("last"))
    ending = rows.where(F.col("to").between(F.col("from") + 1, tail)).select(
        "employee_id", F.col("to").alias("cell"), "version", begin(F.col("to")).alias("first"), F.col("end").alias("last"))

    def nodes(level: int) -> Column:
        """The nodes of a level that the cells from ``from`` + 1 up to but not including ``to`` consist of."""
        left = F.shiftright(F.col("from") + (1 + (1 << level) - 1), level)
        right = F.shiftright("to", level)
        inside = left < right
        node = lambda wanted, index: F.when(inside & wanted, F.struct(F.lit(level).alias("level"), index.alias("node")))
        return F.array_compact(F.array(node(left % 2 == 1, left), node(right % 2 == 1, right - 1)))

    covered = rows.select("employee_id", "version", F.explode(F.concat(*[nodes(k) for k in range(levels + 1)])).alias("at"))
    newest = covered.groupBy("employee_id", "at").agg(F.max("version").alias("version"))
    cells = spans.select("employee_id").distinct().select("employee_id", F.explode(F.sequence(F.lit(0), F.lit(tail))).alias("cell"))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(
        k.alias("level"), F.floor(F.col("cell") / F.pow(F.lit(2), k)).cast("int").alias("node")))).alias("at")
    covering = (cells.select("employee_id", "cell", above).join(newest, ["employee_id", "at"])
                .groupBy("employee_id", "cell").agg(F.max("version").alias("version")))
    covering = covering.select("employee_id", "cell", "version", begin(F.col("cell")).alias("first"), stop(F.col("cell")).alias("last"))
    needed = starting.unionByName(ending).unionByName(covering)
    return needed.select("employee_id", "cell", F.col("version.order").alias("order"), "first", "last", "version.employee_sk",
                         "version.department_sk")


def _cut_at_next(spans: DataFrame) -> DataFrame:
    last_day = F.least(F.col("end_date"), F.date_sub("_next", 1))  # no next: least skips NULL
    return (spans.select("employee_id", F.col("start_date").alias("first_day"), last_day.alias("last_day"),
                         "employee_sk", "department_sk")
            .where("first_day <= last_day"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of versions sorted by employee, cell, start and key; days are numbers.

    ``open_`` holds the versions that may still count, the newest last. One that ends no later than a newer
    one will never count again and is dropped, so ends fall from the first to the last.
    """
    names = ["employee_id", "first_day", "last_day", "employee_sk", "department_sk"]
    person, day, open_ = None, None, []

    def until(last: float) -> Iterator[tuple]:
        nonlocal day
        while open_ and day <= last:
            end, key, department = open_[-1]
            if end < day:
                open_.pop()
                continue
            yield person[0], day, min(end, last), key, department
            day = min(end, last) + 1

    for batch in batches:
        out = []
        for employee, cell, first, end, key, department in zip(*(column.to_pylist() for column in batch.columns)):
            if (employee, cell) != person:
                out += until(float("inf"))
                person, open_ = (employee, cell), []
            else:
                out += until(first - 1)
            while open_ and open_[-1][0] <= end:
                open_.pop()
            open_.append((end, key, department))
            day = first
        yield pa.RecordBatch.from_pydict({n: [row[i] for row in out] for i, n in enumerate(names)}, _segment_schema())
    rest = list(until(float("inf")))
    yield pa.RecordBatch.from_pydict({n: [row[i] for row in rest] for i, n in enumerate(names)}, _segment_schema())


def _segment_schema() -> pa.Schema:
    return pa.schema([("employee_id", pa.string()), ("first_day", pa.int32()), ("last_day", pa.int32()),
                      ("employee_sk", pa.int64()), ("department_sk", pa.int64())])


def _swept(versions: DataFrame) -> DataFrame:
    """Segments of overlapping versions per employee and cell, each with its newest valid one."""
    kinds = dict(versions.dtypes)
    rows = (versions.select("employee_id", F.col("cell").cast("int"), F.col("first").cast("int"), F.col("last").cast("int"),
                            F.col("employee_sk").cast("long"), F.col("department_sk").cast("long"), "order")
            .repartition("employee_id", "cell").sortWithinPartitions("employee_id", "cell", "order", "employee_sk").drop("order"))
    found = rows.mapInArrow(_sweep, "employee_id string, first_day int, last_day int, employee_sk long, department_sk long")
    return found.select("employee_id", F.date_from_unix_date("first_day").alias("first_day"),
                        F.date_from_unix_date("last_day").alias("last_day"),
                        F.col("employee_sk").cast(kinds["employee_sk"]), F.col("department_sk").cast(kinds["department_sk"]))
