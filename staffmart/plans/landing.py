"""Interchange files into staging and operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.operators.audit import audit_check, audit_tables, rating_in_range, require_clean
from staffmart.plans.intake import with_audit_times
from staffmart.schemas import AUDIT_TIMES, FILES, OPERATIONAL, OPERATIONAL_KEYS, OPERATIONAL_REFERENCES, collated
from staffmart.sources.tables import exists, read_csv, read_parquet, require_inputs, together, write_csv
from staffmart.sources.versions import current_load, publish, read_pieces


_LINES = "line_breaks"


def write_files(tables: dict[str, DataFrame], folder: str) -> None:
    """The six CSV files (each a folder of part files), and a note of the rows with line breaks in each."""
    spark = next(iter(tables.values())).sparkSession
    broken = together(spark, {name: lambda name=name, schema=schema: write_csv(
        tables[name].select(*schema.names), f"{folder}/{name}.csv") for name, schema in FILES.items()})
    note = spark.createDataFrame(list(broken.items()), "file string, broken long")
    note.coalesce(1).write.mode("overwrite").json(f"{folder}/{_LINES}")


def read_files(spark: SparkSession, folder: str, multi_line: bool | None = None) -> dict[str, DataFrame]:
    """The six files. One without line breaks inside values is read in splits, many tasks to a file.

    That is known from the note of ``write_files``, or from the caller by ``multi_line=False``; if nobody knows, a file is
    one task.
    """
    require_inputs(spark, [f"{folder}/{name}.csv" for name in FILES])
    broken: dict[str, int] = {}
    if multi_line is None and exists(spark, f"{folder}/{_LINES}"):
        broken = {r.file: r.broken for r in spark.read.schema("file string, broken long").json(f"{folder}/{_LINES}").collect()}

    def lines(name: str) -> bool:
        return broken.get(name, 1) > 0 if multi_line is None else multi_line

    return {name: read_csv(spark, f"{folder}/{name}.csv", schema, multi_line=lines(name)) for name, schema in FILES.items()}


def load_staging(spark: SparkSession, folder: str, root: str, multi_line: bool | None = None) -> dict[str, DataFrame]:
    """Replace the staging tables with what the files hold; ``multi_line`` as in ``read_files``."""
    published = publish(read_files(spark, folder, multi_line), root)
    return {name: read_parquet(spark, f"{published}/{name}", schema) for name, schema in FILES.items()}


def audit_operational(tables: dict[str, DataFrame], collation: bool = False) -> DataFrame:
    """Repeated keys, references to nothing and ratings out of range, as (rule, key, row_count).

    With ``collation`` unique names and emails are repeated if they differ in case and accents only.
    """
    if collation:
        tables = {name: df.select(*[F.col(f.name).cast(f.dataType) for f in collated(name, df.schema)]) for name, df in tables.items()}
    ratings = audit_check(tables["reviews"], rating_in_range()).select(
        F.lit("reviews.rating out of range").alias("rule"), F.col("review_id").alias("key"), F.lit(1).cast("long").alias("row_count"))
    return audit_tables(tables, OPERATIONAL_KEYS, OPERATIONAL_REFERENCES).unionByName(ratings)


def load_operational(spark: SparkSession, staging: dict[str, DataFrame], root: str,
                     collation: bool = False) -> dict[str, DataFrame]:
    """Replace the operational tables; employees get audit times.

    Staged rows that break a key, a reference or a check stop the load, and the tables stay as they are.
    """
    tables = {name: staging[name].select(*schema.names) for name, schema in OPERATIONAL.items()}
    require_clean(audit_operational(tables, collation))
    tables["employees"] = with_audit_times(tables["employees"])
    publish(tables, root)
    return open_operational(spark, root)


def stored_schema(name: str) -> T.StructType:
    """Schema of an operational table as it is stored."""
    schema = OPERATIONAL[name]
    return T.StructType([*schema, *AUDIT_TIMES]) if name == "employees" else schema


def open_operational(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    load = current_load(spark, root)
    if load is None:
        raise FileNotFoundError(f"no complete load under {root}")
    return {name: read_pieces(spark, root, load.of(name), stored_schema(name)) for name in OPERATIONAL}
