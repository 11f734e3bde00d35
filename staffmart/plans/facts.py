"""The review fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.operators.merge import next_key
from staffmart.operators.ordering import with_position
from staffmart.operators.point_in_time import validity_segments
from staffmart.sources.tables import materialise_counted

MEASURES = ["employee_sk", "project_sk", "department_sk", "date_sk", "rating", "review_score",
            "review_count"]
FACT_COLUMNS = ["review_sk", "review_id", *MEASURES, "year_num"]
FACT_PARTITION = "year_num"


def resolve_reviews(reviews: DataFrame, dim_employee: DataFrame, dim_project: DataFrame,
                    dim_date: DataFrame) -> DataFrame:
    """Every review with the keys it resolves to; a key that is missing is NULL.

    The department is that of the version valid on the review date. Segments have few rows
    per employee and at most one match per review, so an employee with a third of all
    reviews makes only the review side uneven, which adaptive execution splits.
    """
    days = dim_date.select(F.col("full_date").alias("review_date"), "date_sk", "year_num")
    segments = validity_segments(dim_employee).withColumnRenamed("employee_id", "_id")
    projects = dim_project.select("project_id", "project_sk")
    rows = reviews.select("review_id", "employee_id", "project_id", "review_date", "rating", "review_score")
    valid = ((F.col("employee_id") == F.col("_id"))
             & F.col("review_date").between(F.col("first_day"), F.col("last_day")))
    return (rows.join(segments, valid, "left")
            .drop("_id", "first_day", "last_day")
            .join(days, "review_date", "left")
            .join(projects, "project_id", "left")
            .withColumn("review_count", F.lit(1)))


def matched(resolved: DataFrame) -> DataFrame:
    """Reviews that become facts: version, project and date are all there."""
    return (resolved
            .where("employee_sk is not null and project_sk is not null and date_sk is not null")
            .select("review_id", *MEASURES, "year_num"))


def unmatched(resolved: DataFrame) -> DataFrame:
    """Reviews that become no fact, with the first reason."""
    reason = (F.when(F.col("employee_sk").isNull(), "no version")
              .when(F.col("project_sk").isNull(), "no project")
              .when(F.col("date_sk").isNull(), "no date"))
    return (resolved.withColumn("reason", reason).where("reason is not null")
            .select("review_id", "employee_id", "project_id", "review_date", "reason"))


def build_fact(reviews: DataFrame, dim_employee: DataFrame, dim_project: DataFrame,
               dim_date: DataFrame) -> DataFrame:
    """One row per matched review, numbered by date and review."""
    rows = matched(resolve_reviews(reviews, dim_employee, dim_project, dim_date))
    return with_position(rows, "review_sk", ["date_sk", "review_id"]).select(*FACT_COLUMNS)


class DuplicateKeys(ValueError):
    """Rows share a key that must be unique."""


ACTIONS = ("inserted", "updated", "unchanged")


def merge_fact(fact: DataFrame, resolved: DataFrame) -> DataFrame:
    """``merge_counted`` without its counts."""
    return merge_counted(fact, resolved)[0]


def merge_counted(fact: DataFrame, resolved: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Fact table after an upsert by review_id, with ``action`` and ``old_year`` per row; a written table.

    Stored reviews keep review_sk and take the new measures, so they point to the version
    valid now. Reviews stored but not given stay unchanged. New ones are numbered on. One full outer
    join does it; given rows are counted by review_id on the way, and a review given twice stops the merge.
    The rows per action are counted as the joined rows are written.
    """
    values = [*MEASURES, "year_num"]
    given = matched(resolved).groupBy("review_id").agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(f"_{c}") for c in values])
    differs = F.lit(False)
    for c in MEASURES:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = (F.when(F.col("review_sk").isNull(), "inserted").when(F.col("_copies").isNull(), "unchanged")
              .when(differs, "updated").otherwise("unchanged"))
    joined = fact.select(*FACT_COLUMNS).join(given, "review_id", "full_outer").select(
        "review_sk", "review_id", *[F.when(F.col("_copies").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in values],
        action.alias("action"), F.when(F.col("review_sk").isNotNull(), F.col("year_num")).alias("old_year"), "_copies")
    joined, counts = materialise_counted(joined, "merged", repeated=F.count_if(F.col("_copies") > 1), **{
        name: F.count_if(F.col("action") == name) for name in ACTIONS})
    if counts.pop("repeated"):
        repeated = [r.review_id for r in joined.where("_copies > 1").select("review_id").limit(20).collect()]
        raise DuplicateKeys("duplicate values of review_id: " + ", ".join(sorted(map(str, repeated))))
    added = with_position(joined.where("action = 'inserted'").drop("review_sk", "_copies"), "review_sk",
                          ["date_sk", "review_id"], next_key(fact, "review_sk"))
    return joined.where("action <> 'inserted'").drop("_copies").unionByName(added), counts


def load_reviews(fact: DataFrame, reviews: DataFrame, review_ids: DataFrame, dim_employee: DataFrame,
                 dim_project: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Upsert of the named reviews only."""
    chosen = reviews.join(review_ids.select("review_id"), "review_id", "left_semi")
    return merge_fact(fact, resolve_reviews(chosen, dim_employee, dim_project, dim_date))


def touched_years(merged: DataFrame) -> list[int]:
    """Years in which a row was inserted or changed, or that a row has left; as many as there are years at most."""
    changed = merged.where("action <> 'unchanged'")
    years = changed.select("year_num").union(changed.where("old_year is not null").select("old_year")).distinct()
    return sorted(r.year_num for r in years.collect())
