"""Tables built once per session from the given data: operational tables and warehouses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks import mapping
from staffmart.plans import landing
from staffmart.plans.warehouse import Warehouse, open_warehouse, publish_refresh, rebuild, refresh
from staffmart.sources.tables import work_path

CURRENT_START = "1998-01-01"
_built: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the six CSV files."""
    def build():
        folder = work_path(spark, "files")
        landing.write_files(mapping.tables(spark, sf_dir), folder)
        return folder
    return once(spark, sf_dir, "files", build)


def staging(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return once(spark, sf_dir, "staging", lambda: landing.load_staging(
        spark, files(spark, sf_dir), work_path(spark, "staging")))


def operational(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return once(spark, sf_dir, "operational", lambda: landing.load_operational(
        spark, staging(spark, sf_dir), work_path(spark, "operational")))


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What the warehouse is built from: operational tables and the staged history."""
    return {**operational(spark, sf_dir), "employee_history": staging(spark, sf_dir)["employee_history"]}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return once(spark, sf_dir, "warehouse", lambda: rebuild(
        spark, inputs(spark, sf_dir), work_path(spark, "warehouse"), CURRENT_START))


def base_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Warehouse of the earlier state, for upserts and refreshes."""
    return once(spark, sf_dir, "base", lambda: rebuild(
        spark, mapping.base_tables(spark, sf_dir), work_path(spark, "base"), CURRENT_START))


def kept_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The earlier state with its sums kept by year, brought up to date by a refresh that is published."""
    def build():
        root = work_path(spark, "kept")
        base = rebuild(spark, mapping.base_tables(spark, sf_dir), root, CURRENT_START, keep_sums=True)
        publish_refresh(refresh(mapping.tables(spark, sf_dir), base), root)
        return open_warehouse(spark, root)
    return once(spark, sf_dir, "kept", build)
