"""Sums of the facts kept by year with each load, from which the reports are answered.

All of them can be merged, so a refresh works out the touched years only and shares the others. Distinct employees of a project are
kept as bitmaps of their keys, 32,768 keys each; the bitmaps of several years are joined by "or", and their bits are counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.plans.facts import FACT_PARTITION
from staffmart.sources.versions import Load, Piece, read_pieces, write_parts

_TOTAL, _YEAR = T.DecimalType(38, 2), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in [*fields.items(), (FACT_PARTITION, _YEAR)]])


SUMS = {
    "sums_by_department": _schema(department_sk=T.LongType(), _total=_TOTAL, _n=T.LongType()),
    "sums_by_employee": _schema(employee_sk=T.LongType(), department_sk=T.LongType(), _total=_TOTAL, _n=T.LongType()),
    "sums_by_project": _schema(project_sk=T.LongType(), _total=_TOTAL, _n=T.LongType()),
    "people_by_project": _schema(project_sk=T.LongType(), bucket=T.LongType(), people=T.BinaryType()),
}


@dataclass
class KeptSums:
    by_department: DataFrame
    by_employee: DataFrame
    by_project: DataFrame
    people_by_project: DataFrame


def _summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda fact: fact.groupBy(FACT_PARTITION, *keys).agg(
        F.sum("review_score").cast(_TOTAL).alias("_total"), F.count(F.lit(1)).alias("_n"))


def _people(fact: DataFrame) -> DataFrame:
    key = F.col("employee_sk")
    return (fact.groupBy(FACT_PARTITION, "project_sk", F.bitmap_bucket_number(key).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("people")))


_BUILD = {"sums_by_department": _summed("department_sk"), "sums_by_employee": _summed("employee_sk", "department_sk"),
          "sums_by_project": _summed("project_sk"), "people_by_project": _people}


def write_sums(fact: DataFrame, root: str) -> dict[str, Callable[[], list[Piece]]]:
    """Jobs that write the sums of the given facts, one piece per year and table."""
    return {name: lambda name=name, build=build: write_parts(
        build(fact).select(*SUMS[name].names), root, name, FACT_PARTITION) for name, build in _BUILD.items()}


def open_sums(spark: SparkSession, root: str, load: Load) -> KeptSums | None:
    """The sums of a load, or None if it has none."""
    if not load.of("sums_by_department"):
        return None
    tables = [read_pieces(spark, root, load.of(name), schema) for name, schema in SUMS.items()]
    return KeptSums(*tables)


def people_per_project(people: DataFrame, key: str) -> DataFrame:
    """Distinct employees per ``key`` (a column of projects joined to the bitmaps)."""
    return (people.groupBy(key, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("people")).alias("n"))
            .groupBy(key).agg(F.sum("n").alias("people")))
