"""Data checks that a database would do with keys and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.operators.ordering import sorted_chunks, with_next
from staffmart.schemas import TEXT_LIMITS


def audit_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"))
            .where(F.col("row_count") > 1))


def audit_not_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per column: rows without a required value, and rows with too long a text. One pass."""
    sums = []
    for field in schema:
        col = F.col(field.name)
        limit = TEXT_LIMITS.get(field.name)
        missing = F.lit(0) if field.nullable else F.count_if(col.isNull())
        too_long = F.lit(0) if limit is None else F.count_if(F.length(col) > limit)
        sums.append(F.struct(F.lit(field.name).alias("column_name"),
                             missing.cast("long").alias("missing"),
                             too_long.cast("long").alias("too_long")))
    return df.agg(F.array(*sums).alias("checks")).select(F.explode("checks").alias("check")).select("check.*")


def audit_references(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child keys without a parent, with their row count. NULL refers to nothing and is fine."""
    used = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    known = parent.select(F.col(parent_key or key).alias(key))
    return used.join(known, key, "left_anti")


def _text(column: str) -> Column:
    """A value as plain text, whatever its collation."""
    return F.collate(F.col(column).cast("string"), "UTF8_BINARY")


def audit_tables(tables: dict[str, DataFrame], keys: list[tuple[str, str]],
                 references: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, key, row_count) of every repeated key and every reference to nothing, over several tables.

    A NULL key is none, as in a database.
    """
    found = [audit_unique(tables[table].where(F.col(column).isNotNull()), column)
             .select(F.lit(f"{table}.{column} repeated").alias("rule"), _text(column).alias("key"), "row_count")
             for table, column in keys]
    found += [audit_references(tables[child], tables[parent], column)
              .select(F.lit(f"{child}.{column} not in {parent}").alias("rule"), F.col(column).cast("string").alias("key"), "row_count")
              for child, column, parent in references]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class BrokenRules(ValueError):
    """Rows that a database would refuse."""


def require_clean(findings: DataFrame) -> None:
    """Raise an error that names some of the findings, if there are any."""
    some = findings.limit(20).collect()  # for the message only
    if some:
        raise BrokenRules("; ".join(f"{r.rule}: {r.key} ({r.row_count})" for r in some))


def audit_check(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false; an unknown result passes, as in SQL."""
    return df.where(~rule)


def rating_in_range(column: str = "rating") -> Column:
    return F.col(column).between(1, 5)


def audit_versions(dim_employee: DataFrame) -> DataFrame:
    """Employees whose versions do not form one history, with rule and row count.

    * ``current versions``: not exactly one current version
    * ``start after end``: a version that ends before it starts
    * ``overlap``: a version that starts before the one before it has ended; a shared
      boundary day is fine
    """
    spans = dim_employee.select("employee_id", "employee_sk", "start_date", "end_date", "is_current")
    chunks = sorted_chunks(spans, ["employee_id", "start_date", "employee_sk"], "versions")
    per_employee = (with_next(chunks, "employee_id", "start_date", "_next_start")
                    .groupBy("employee_id")
                    .agg(F.count_if("is_current").alias("current"),
                         F.count_if(F.col("start_date") > F.col("end_date")).alias("backward"),
                         F.count_if(F.col("_next_start") < F.col("end_date")).alias("overlap")))
    finding = F.explode(F.array(
        F.struct(F.lit("current versions").alias("rule"), F.col("current").alias("row_count"),
                 (F.col("current") != 1).alias("broken")),
        F.struct(F.lit("start after end").alias("rule"), F.col("backward").alias("row_count"),
                 (F.col("backward") > 0).alias("broken")),
        F.struct(F.lit("overlap").alias("rule"), F.col("overlap").alias("row_count"),
                 (F.col("overlap") > 0).alias("broken"))))
    return (per_employee.select("employee_id", finding.alias("f")).where("f.broken")
            .select("employee_id", "f.rule", "f.row_count"))
