"""Star schema as a set of tables: full rebuild, incremental refresh, load summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.operators.merge import upsert
from staffmart.plans.dimensions import (
    build_dim_date, build_dim_department, build_dim_employee, build_dim_project, first_versions,
    missing_dates)
from staffmart.plans.facts import (
    FACT_COLUMNS, FACT_PARTITION, DuplicateKeys, build_fact, merge_counted, resolve_reviews, touched_years)
from staffmart.plans.sums import SUMS, KeptSums, open_sums, write_sums
from staffmart.schemas import STAR
from staffmart.sources.tables import materialise_counted, together, written_counts
from staffmart.sources.versions import (
    Load, Piece, current_load, enter, new_folder, read_pieces, write_parts, write_whole)


# Keys a star schema is built on.
UNIQUE = [("departments", "department_id"), ("employees", "employee_id"), ("projects", "project_id"),
          ("reviews", "review_id")]


# Lines of the load summary; their counts are notes of the load.
SUMMARY = ["departments", "projects", "dates", "reviews", "facts", "historical_versions", "current_versions"]
_COUNT = "count_"


@dataclass
class Warehouse:
    dim_department: DataFrame
    dim_project: DataFrame
    dim_date: DataFrame
    dim_employee: DataFrame
    fact: DataFrame
    counts: dict[str, int] | None = None  # what the load counted as it wrote the tables
    sums: KeptSums | None = None  # by year, if the load keeps them


def open_load(spark: SparkSession, root: str, load: Load) -> Warehouse:
    counts = {name: int(load.notes[_COUNT + name]) for name in SUMMARY if _COUNT + name in load.notes}
    return Warehouse(**{name: read_pieces(spark, root, load.of(name), schema) for name, schema in STAR.items()},
                     counts=counts if len(counts) == len(SUMMARY) else None, sums=open_sums(spark, root, load))


def open_warehouse(spark: SparkSession, root: str) -> Warehouse:
    """The tables of the newest complete load."""
    load = current_load(spark, root)
    if load is None:
        raise FileNotFoundError(f"no complete load under {root}")
    return open_load(spark, root, load)


def rebuild(spark: SparkSession, tables: dict[str, DataFrame], root: str, current_start=None,
            keep_sums: bool = False) -> Warehouse:
    """Build all five tables from departments, employees, projects, reviews and
    employee_history, in a new folder that becomes current when it is complete.

    Repeated keys stop it: they would give two current versions or two facts of one review. With
    ``keep_sums`` the reports' sums by year are stored too, and refreshes keep them up to date.
    """
    folder = new_folder(root)
    given = together(spark, {key: lambda table=table, key=key: _counted_unique(tables[table], key) for table, key in UNIQUE})
    pieces: list[Piece] = []
    counts: dict[str, int] = {"reviews": given["review_id"]}

    def store(name: str, df: DataFrame, column: str | None = None, **wanted: Column) -> DataFrame:
        own: list[Piece] = []
        counts.update(written_counts(df, lambda rows: own.extend(
            write_parts(rows, root, name, column) if column else write_whole(rows, root, folder, name)), **wanted))
        pieces.extend(own)
        return read_pieces(spark, root, own, STAR[name])

    every = F.count(F.lit(1))

    def people() -> tuple[DataFrame, DataFrame]:
        departments = store("dim_department", build_dim_department(tables["departments"]), departments=every)
        return departments, store("dim_employee", build_dim_employee(
            tables["employees"], tables["employee_history"], departments, current_start),
            historical_versions=F.count_if(~F.col("is_current")), current_versions=F.count_if("is_current"))

    done = together(spark, {
        "people": people,
        "projects": lambda: store("dim_project", build_dim_project(tables["projects"]), projects=every),
        "dates": lambda: store("dim_date", build_dim_date(tables["reviews"]), dates=every)})
    (departments, employees), projects, dates = done["people"], done["projects"], done["dates"]
    fact = store("fact", build_fact(tables["reviews"], employees, projects, dates), FACT_PARTITION, facts=every)
    if keep_sums:
        pieces += [p for own in together(spark, write_sums(fact, root)).values() for p in own]
    enter(spark, root, folder, pieces, {_COUNT + name: n for name, n in counts.items()})
    return open_warehouse(spark, root)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table, as one distributed job."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def _counted(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """(table_name, row_count) of the rows that meet each condition, in one pass."""
    counts = df.agg(*[F.count_if(F.expr(condition)).alias(name) for name, condition in conditions.items()])
    return counts.unpivot([], list(conditions), "table_name", "row_count")


def summary_frame(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "table_name string, row_count long")


def load_summary(tables: dict[str, DataFrame], warehouse: Warehouse) -> DataFrame:
    """Rows per dimension, versions by kind, reviews given and facts written.

    A load has counted them as it wrote its tables. For tables from elsewhere they are counted now.
    """
    if warehouse.counts is not None:
        return summary_frame(warehouse.fact.sparkSession, {name: warehouse.counts[name] for name in SUMMARY})
    versions = _counted(warehouse.dim_employee, {
        "historical_versions": "not is_current", "current_versions": "is_current"})
    return row_counts({
        "departments": warehouse.dim_department,
        "projects": warehouse.dim_project,
        "dates": warehouse.dim_date,
        "reviews": tables["reviews"],
        "facts": warehouse.fact,
    }).unionByName(versions)


def _counted_unique(df: DataFrame, key: str) -> int:
    """The number of rows; raises if two share a key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = per_key.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if found.repeated:
        raise DuplicateKeys(f"duplicate values of {key}")
    return found.rows or 0


@dataclass
class Refresh:
    """Tables after a refresh; ``fact`` also has ``action`` per row. ``counts`` were taken as they were written."""

    warehouse: Warehouse
    added_dates: DataFrame
    added_versions: DataFrame
    counts: dict[str, int]

    def summary(self) -> DataFrame:
        return summary_frame(self.warehouse.fact.sparkSession, self.counts)


def refresh(tables: dict[str, DataFrame], warehouse: Warehouse) -> Refresh:
    """Bring operational rows into an existing warehouse without replacing it.

    Departments and projects are upserted, only missing dates and employees are added, and
    every review is upserted against the version valid on its date.
    """
    spark = warehouse.fact.sparkSession
    # The merge of the facts looks for repeated reviews itself.
    given = together(spark, {key: lambda table=table, key=key: _counted_unique(tables[table], key)
                             for table, key in UNIQUE if table != "reviews"})
    every = F.count(F.lit(1))

    def people() -> tuple[DataFrame, tuple[DataFrame, dict[str, int]]]:
        departments = upsert(warehouse.dim_department, tables["departments"], "department_id", "department_sk")
        return departments, materialise_counted(
            first_versions(warehouse.dim_employee, tables["employees"], departments), "first-versions", n=every)

    def projects_now() -> DataFrame:
        return upsert(warehouse.dim_project, tables["projects"], "project_id", "project_sk")

    done = together(spark, {
        "people": people, "projects": projects_now,
        "dates": lambda: materialise_counted(missing_dates(warehouse.dim_date, tables["reviews"]), "dates", n=every)})
    (departments, (added_versions, people_n)), projects, (added_dates, dates_n) = done["people"], done["projects"], done["dates"]
    dates = warehouse.dim_date.unionByName(added_dates)
    versions = warehouse.dim_employee.unionByName(added_versions)
    resolved = resolve_reviews(tables["reviews"], versions, projects, dates)
    fact, actions = merge_counted(warehouse.fact, resolved)
    counts = {"departments_synced": given["department_id"], "projects_synced": given["project_id"], "dates_added": dates_n["n"],
              "new_employees": people_n["n"], **{f"reviews_{name}": n for name, n in actions.items()}}
    return Refresh(Warehouse(departments, projects, dates, versions, fact), added_dates, added_versions, counts)


# A table that grows by pieces is written anew when it has so many.
MOST_PIECES = 20


def publish_refresh(result: Refresh, root: str) -> str:
    """Write what the refresh changed and make it current, in one entry with all that stayed as it was.

    Of the facts and their sums the touched years are written. Calendar and employees only get the added rows, as a
    piece of their own. Departments and projects are written anew; they are upserted whole.
    """
    spark = result.warehouse.fact.sparkSession
    load = current_load(spark, root)
    folder = new_folder(root)
    years = touched_years(result.warehouse.fact)

    def facts() -> list[Piece]:
        kept = [p for p in load.of("fact") if int(p.part) not in years]
        rows = result.warehouse.fact.where(F.col(FACT_PARTITION).isin(years)).select(*FACT_COLUMNS)
        return kept + (write_parts(rows, root, "fact", FACT_PARTITION) if years else [])

    def grown(name: str, added: DataFrame) -> list[Piece]:
        own, names = load.of(name), STAR[name].names
        if len(own) >= MOST_PIECES:
            return write_whole(getattr(result.warehouse, name).select(*names), root, folder, name)
        return own if added.isEmpty() else own + write_whole(added.select(*names), root, folder, name)

    def anew(name: str) -> list[Piece]:
        return write_whole(getattr(result.warehouse, name).select(*STAR[name].names), root, folder, name)

    def sums() -> list[Piece]:
        """Sums of the touched years, if the load before has any; those of other years stay."""
        old = [p for name in SUMS for p in load.of(name)]
        if not old or not years:
            return old
        rows = result.warehouse.fact.where(F.col(FACT_PARTITION).isin(years)).select(*FACT_COLUMNS)
        new = together(spark, write_sums(rows, root))
        return [p for p in old if int(p.part) not in years] + [p for own in new.values() for p in own]

    written = together(spark, {
        "fact": facts, "sums": sums, "dim_date": lambda: grown("dim_date", result.added_dates),
        "dim_employee": lambda: grown("dim_employee", result.added_versions),
        "dim_department": lambda: anew("dim_department"), "dim_project": lambda: anew("dim_project")})
    enter(spark, root, folder, [p for own in written.values() for p in own], after=load.version)
    return folder
