"""One callable per operator and report, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import mapping, stores
from checks.mapping import AS_OF
from staffmart import schemas
from staffmart.functions import dates, numbers, text
from staffmart.operators import audit, merge, point_in_time, scd2, validate
from staffmart.plans import appends, dimensions, facts, intake, reports, synth
from staffmart.plans import warehouse as wh
from staffmart.sources import tables as io
from staffmart.sources.versions import publish, read_pieces
from staffmart.streaming import changes
from staffmart.streaming import intake as streams

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers as double, dates as text: equal in any engine."""
    out = []
    for field in df.schema:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)


# --- files and loads ------------------------------------------------------------------

def src_csv_roundtrip(spark, sf):
    """Comments with outer spaces, quotes, commas and line breaks come back as they were."""
    path = io.work_path(spark, "reviews-csv")
    io.write_csv(mapping.reviews(spark, sf).withColumn("comments", F.concat(
        F.lit('  "'), "comments", F.lit('", \n and\\ more ')), ), path)
    return io.read_csv(spark, path, schemas.REVIEWS)


def csv_reordered(spark, sf):
    """Columns in another order, one too many, missing values in all spellings; rows that do not fit are set apart."""
    path = io.work_path(spark, "reordered-csv")
    mapping.reviews_as_text(spark, sf).write.options(header=True, quote='"', escape='"').csv(path)
    good = io.read_csv(spark, path, schemas.REVIEWS, bad="skip").withColumn("reason", F.lit(None).cast("string"))
    bad = io.bad_csv_rows(spark, path, schemas.REVIEWS).select("review_id", "reason")
    return good.unionByName(bad, allowMissingColumns=True)


def staging_load(spark, sf):
    return wh.row_counts(stores.staging(spark, sf))


def oltp_load(spark, sf):
    return stores.operational(spark, sf)["employees"].drop("created_at", "updated_at")


def load_summary(spark, sf):
    return wh.load_summary(stores.inputs(spark, sf), stores.warehouse(spark, sf))


def null_normalise(spark, sf):
    return io.nulls_for_missing(mapping.dirty_numbers(spark, sf))


# --- dimensions and facts -------------------------------------------------------------

def dim_department(spark, sf):
    return dimensions.build_dim_department(mapping.departments(spark, sf))


def dim_project(spark, sf):
    return dimensions.build_dim_project(mapping.projects(spark, sf))


def dim_date_full(spark, sf):
    return dimensions.build_dim_date(mapping.reviews(spark, sf))


def dim_employee_full(spark, sf):
    w = stores.warehouse(spark, sf)
    given = stores.inputs(spark, sf)
    return dimensions.build_dim_employee(given["employees"], given["employee_history"], w.dim_department,
                                         stores.CURRENT_START)


def review_dates_distinct(spark, sf):
    return dimensions.review_dates(mapping.reviews(spark, sf))


def fact_full(spark, sf):
    w = stores.warehouse(spark, sf)
    return facts.build_fact(stores.operational(spark, sf)["reviews"], w.dim_employee, w.dim_project, w.dim_date)


def fact_unmatched(spark, sf):
    w = stores.warehouse(spark, sf)
    return facts.unmatched(facts.resolve_reviews(
        stores.operational(spark, sf)["reviews"], w.dim_employee, w.dim_project, w.dim_date))


def scd2_point_in_time(spark, sf):
    return point_in_time.versions_on(stores.warehouse(spark, sf).dim_employee, "1997-06-30")


def version_at_start(spark, sf):
    """The version valid on the day another one starts, over versions that overlap in every way."""
    versions = mapping.raw_versions(spark, sf).withColumn("department_sk", F.lit(1))
    segments = point_in_time.validity_segments(versions).select(
        F.col("employee_id").alias("_id"), "first_day", "last_day", F.col("employee_sk").alias("valid_sk"))
    inside = (F.col("employee_id") == F.col("_id")) & F.col("start_date").between(F.col("first_day"), F.col("last_day"))
    return versions.join(segments, inside).select("employee_sk", "start_date", "valid_sk")


def multi_version_employees(spark, sf):
    return point_in_time.version_counts(stores.warehouse(spark, sf).dim_employee)


# --- reports --------------------------------------------------------------------------

def employee_directory(spark, sf):
    t = stores.operational(spark, sf)
    return reports.employee_directory(t["employees"], t["departments"])


def employee_lookup(spark, sf):
    found = reports.employee_lookup(spark, stores.operational(spark, sf)["employees"], "E000042")
    return found.drop("created_at", "updated_at")


def employee_exists(spark, sf):
    t = stores.operational(spark, sf)
    return reports.employee_exists(t["assignments"], t["employees"].where("hire_date < date'1996-01-01'"))


def department_list(spark, sf):
    return reports.department_list(stores.operational(spark, sf)["departments"])


def project_list(spark, sf):
    return reports.project_list(stores.operational(spark, sf)["projects"])


def kpis(spark, sf):
    return reports.kpis(stores.warehouse(spark, sf))


def yearly_trend(spark, sf):
    return reports.yearly_trend(stores.warehouse(spark, sf))


def top_employees(spark, sf):
    return reports.top_employees(stores.warehouse(spark, sf))


def top_employees_by_sk(spark, sf):
    return reports.top_employees_by_sk(stores.warehouse(spark, sf))


def project_bottlenecks(spark, sf):
    return reports.project_bottlenecks(stores.warehouse(spark, sf))


def project_bottlenecks_people(spark, sf):
    return reports.project_bottlenecks(stores.warehouse(spark, sf), by="employee_id")


def project_bottlenecks_by_id(spark, sf):
    return reports.project_bottlenecks_by_id(stores.warehouse(spark, sf))


def department_performance(spark, sf):
    return reports.department_performance(stores.warehouse(spark, sf))


def attrition_risk(spark, sf):
    return reports.attrition_risk(stores.warehouse(spark, sf), AS_OF)


def attrition_distribution(spark, sf):
    return reports.attrition_distribution(stores.warehouse(spark, sf), AS_OF)


def attrition_top15(spark, sf):
    return reports.attrition_top(stores.warehouse(spark, sf), AS_OF, 15)


def published_facts(spark, sf):
    """The facts as a reader finds them after a refresh that wrote the touched years only."""
    return stores.kept_warehouse(spark, sf).fact


def _kept(report):
    """A report answered from sums kept by year, after a refresh."""
    def query(spark, sf):
        return report(stores.kept_warehouse(spark, sf))
    query.__name__ = f"kept_{report.__name__}"
    return query


KEPT = [_kept(report) for report in (
    reports.kpis, reports.yearly_trend, reports.top_employees, reports.top_employees_by_sk, reports.project_bottlenecks,
    reports.project_bottlenecks_by_id, reports.department_performance)]


def scalar_functions(spark, sf):
    o, d, price = F.col("o_orderkey"), F.col("o_orderdate").cast("date"), F.col("o_totalprice")
    raw = F.when(o % 4 == 0, "abc").when(o % 4 == 1, " 18.9 ").when(o % 4 == 2, "-7").otherwise("1e3")
    return mapping.table(spark, sf, "orders").select(
        o.alias("row_id"),
        dates.date_key(d).alias("date_key"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter_num"),
        dates.completed_years(d, F.lit(AS_OF).cast("date")).alias("years"),
        F.date_add(d, 45).alias("later"),
        F.datediff(F.lit(AS_OF).cast("date"), d).alias("days"),
        F.round(price.cast("decimal(15,2)") / 3, 2).alias("third"),
        F.rint(F.col("o_custkey") / F.lit(2.0)).alias("half_even"),
        numbers.clip(o, 100, 900).alias("clipped"),
        (F.pmod(o, F.lit(6)) + 1).alias("rotated"),
        text.numbered("R", o + 1, 7).alias("padded"),
        text.strip(F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit(" "))).alias("stripped"),
        F.upper(F.lower("o_orderpriority")).alias("upper"),
        numbers.safe_int(raw, -1).alias("as_int"),
        numbers.safe_float(raw, -1.0).alias("as_float"),
        text.matches(F.col("o_orderpriority"), r"[0-9]-[A-Z ]+").alias("is_priority"),
        F.col("o_orderpriority").rlike(r"\p{L}").alias("has_letter"),
        text.hashed_id("R", 12, F.lit("R"), o).alias("hashed"))


# --- upserts and changes --------------------------------------------------------------

def upsert_department(spark, sf):
    return merge.upsert(stores.base_warehouse(spark, sf).dim_department, mapping.departments(spark, sf),
                        "department_id", "department_sk")


def upsert_project(spark, sf):
    return merge.upsert(stores.base_warehouse(spark, sf).dim_project, mapping.projects(spark, sf),
                        "project_id", "project_sk")


def insert_ignore_dates(spark, sf):
    return dimensions.extend_dim_date(stores.base_warehouse(spark, sf).dim_date, mapping.reviews(spark, sf))


def new_employees(spark, sf):
    base = stores.base_warehouse(spark, sf)
    return dimensions.append_new_employees(base.dim_employee, mapping.employees(spark, sf), base.dim_department)


def fact_incremental(spark, sf):
    result = wh.refresh(mapping.tables(spark, sf), stores.base_warehouse(spark, sf))
    return result.warehouse.fact.drop("old_year")


def fact_load_reviews(spark, sf):
    """The reviews with the lowest rating, loaded one set at a time into the base facts."""
    base = stores.base_warehouse(spark, sf)
    given = mapping.reviews(spark, sf)
    merged = facts.load_reviews(base.fact, given, given.where("rating = 1"), base.dim_employee,
                                base.dim_project, base.dim_date)
    return merged.drop("old_year")


def refresh_summary(spark, sf):
    return wh.refresh(mapping.tables(spark, sf), stores.base_warehouse(spark, sf)).summary()


def _changes(spark, sf, policy=scd2.SAME_DAY):
    w = stores.warehouse(spark, sf)
    return scd2.apply_department_changes(w.dim_employee, mapping.department_changes(spark, sf),
                                         stores.operational(spark, sf)["employees"], w.dim_department, policy)


def scd2_apply(spark, sf):
    return _changes(spark, sf).dim_employee


def scd2_apply_day_before(spark, sf):
    return _changes(spark, sf, scd2.DAY_BEFORE).dim_employee


def scd2_employees(spark, sf):
    changed = F.col("updated_at") > F.col("created_at")
    return _changes(spark, sf).employees.withColumn("changed", changed).drop("created_at", "updated_at")


def scd2_rejects(spark, sf):
    return _changes(spark, sf).rejects


# --- checks and submissions -----------------------------------------------------------

def validate_employees(spark, sf):
    return validate.validate_employees(mapping.employee_submissions(spark, sf), AS_OF)


def validate_employees_write(spark, sf):
    return validate.validate_employees(mapping.employee_submissions(spark, sf), AS_OF, validate.WRITE)


def dq_unique(spark, sf):
    return audit.audit_unique(mapping.department_changes(spark, sf), "employee_id", "effective_date")


def dq_not_null(spark, sf):
    submitted = io.nulls_for_missing(mapping.employee_submissions(spark, sf))
    fields = [f for f in schemas.EMPLOYEES if f.name in submitted.columns]
    return audit.audit_not_null(submitted, T.StructType(fields))


def dq_referential(spark, sf):
    return audit.audit_references(mapping.reviews(spark, sf), mapping.base_tables(spark, sf)["employees"],
                                  "employee_id")


def dq_operational(spark, sf):
    """All keys and references of the operational tables, with employees and projects of an earlier state."""
    now, early = mapping.tables(spark, sf), mapping.base_tables(spark, sf)
    tables = {**now, "employees": early["employees"], "projects": early["projects"],
              "reviews": now["reviews"].unionByName(early["reviews"])}
    return audit.audit_tables(tables, schemas.OPERATIONAL_KEYS, schemas.OPERATIONAL_REFERENCES)


def dq_star(spark, sf):
    """All keys and references of the star schema, its facts against the dimensions of an earlier one."""
    now, early = stores.warehouse(spark, sf), stores.base_warehouse(spark, sf)
    tables = {"dim_department": early.dim_department, "dim_project": early.dim_project, "dim_date": early.dim_date,
              "dim_employee": early.dim_employee, "fact": now.fact}
    return (audit.audit_tables(tables, schemas.STAR_KEYS, schemas.STAR_REFERENCES)
            .groupBy("rule").agg(F.count(F.lit(1)).alias("keys"), F.sum("row_count").alias("row_count")))


def dq_check(spark, sf):
    return audit.audit_check(mapping.review_submissions(spark, sf), audit.rating_in_range())


def dq_scd2(spark, sf):
    return audit.audit_versions(mapping.raw_versions(spark, sf))


def _both(result: intake.Intake, key: str) -> DataFrame:
    """Accepted and refused rows in one frame."""
    good = result.accepted.withColumn("reject_reason", F.lit(None).cast("string"))
    bad = result.quarantine.select(F.col("submission_id").cast("string").alias(key), "reject_reason")
    return good.unionByName(bad, allowMissingColumns=True)


def intake_employees(spark, sf):
    """Every fifth form is sent twice, every fourth was taken in before."""
    forms = mapping.employee_submissions(spark, sf)
    stored = mapping.stored_keys(forms, "E", "employee_id", 4).withColumn("email", F.lit(None).cast("string"))
    return _both(intake.intake_employees(mapping.twice(forms, 5), stored, AS_OF,
                                         departments=mapping.departments(spark, sf)), "employee_id")


def intake_employees_insensitive(spark, sf):
    """Emails that differ in case only are one; every fourth was taken in before, in small letters."""
    forms = mapping.employee_submissions(spark, sf)
    stored = forms.where(F.col("submission_id") % 4 == 1).select(F.lit("E-none").alias("employee_id"), F.upper("email").alias("email"))
    return _both(intake.intake_employees(mapping.shouted(forms), stored, AS_OF, departments=mapping.departments(spark, sf),
                                         collation=True), "employee_id")


def intake_projects(spark, sf):
    forms = mapping.project_submissions(spark, sf)
    return _both(intake.intake_projects(mapping.twice(forms, 5), mapping.stored_keys(forms, "P", "project_id", 4)), "project_id")


def intake_assignments(spark, sf):
    forms = mapping.assignment_submissions(spark, sf)
    return _both(intake.intake_assignments(
        mapping.twice(forms, 5), mapping.employees(spark, sf), mapping.projects(spark, sf),
        mapping.stored_keys(forms, "A", "assignment_id", 4)), "assignment_id")


def intake_reviews(spark, sf):
    forms = mapping.review_submissions(spark, sf)
    return _both(intake.intake_reviews(
        mapping.twice(forms, 5), mapping.employees(spark, sf), mapping.projects(spark, sf),
        mapping.stored_keys(forms, "R", "review_id", 4)), "review_id")


# --- generator ------------------------------------------------------------------------

def _generator(spark, sf) -> synth.Generator:
    seed = mapping.seed(spark, sf)
    return synth.Generator(spark, seed, rows=3 * seed.count())


def synth_seed(spark, sf):
    path = io.work_path(spark, "seed")
    io.write_csv(mapping.seed(spark, sf), path)
    return synth.load_seed(spark, path)


def synth_employees(spark, sf):
    return _generator(spark, sf).employees()


def synth_projects(spark, sf):
    g = _generator(spark, sf)
    load = g.assignments().groupBy("project_id").agg(F.count(F.lit(1)).alias("assigned"))
    return g.projects().join(load, "project_id", "left")


def synth_assignments(spark, sf):
    return _generator(spark, sf).assignments()


def synth_reviews(spark, sf):
    return _generator(spark, sf).reviews()


def synth_history(spark, sf):
    return _generator(spark, sf).history()


def review_date_guardrail(spark, sf):
    return synth.keep_review_year(mapping.reviews(spark, sf)).select("review_id", "review_date", "comments")


# --- streams --------------------------------------------------------------------------

def _intake_stream(spark, submissions: DataFrame, nameless: DataFrame, judge, key: str, unique=()) -> DataFrame:
    """Submissions that come twice, and some without an id that come once, in several micro-batches."""
    source, root = io.work_path(spark, "submissions"), io.work_path(spark, "intake")
    submissions.unionByName(submissions).unionByName(nameless).repartition(4).write.parquet(source)
    stream = streams.file_stream(spark, source, submissions.schema, files_per_batch=2)
    streams.intake_stream(stream, root, judge, io.work_path(spark, "checkpoint"), unique).awaitTermination()
    return _both(intake.Intake(spark.read.parquet(f"{root}/accepted").drop("batch"),
                               spark.read.parquet(f"{root}/quarantine").drop("batch")), key)


def intake_stream(spark, sf):
    forms = mapping.employee_submissions(spark, sf)
    departments = mapping.departments(spark, sf)
    return _intake_stream(spark, forms, mapping.nameless(forms, F.col("department_id") == 5), lambda rows, stored: intake.intake_employees(
        rows, stored, AS_OF, departments=departments), "employee_id", ["email"])


def intake_stream_projects(spark, sf):
    forms = mapping.project_submissions(spark, sf)
    return _intake_stream(spark, forms, mapping.nameless(forms, F.col("start_date").isNull()), intake.intake_projects, "project_id")


def intake_stream_assignments(spark, sf):
    forms = mapping.assignment_submissions(spark, sf)
    employees, projects = mapping.employees(spark, sf), mapping.projects(spark, sf)
    return _intake_stream(spark, forms, mapping.nameless(forms, F.col("project_id") == "P0005"), lambda rows, stored: intake.intake_assignments(
        rows, employees, projects, stored), "assignment_id")


def intake_stream_reviews(spark, sf):
    forms = mapping.review_submissions(spark, sf)
    employees, projects = mapping.employees(spark, sf), mapping.projects(spark, sf)
    return _intake_stream(spark, forms, mapping.nameless(forms, F.col("rating") == 6), lambda rows, stored: intake.intake_reviews(
        rows, employees, projects, stored), "review_id")


def _early_store(spark, sf) -> str:
    """Operational tables of the earlier state, published without audits."""
    root, early = io.work_path(spark, "early"), mapping.base_tables(spark, sf)
    tables = {name: early[name].select(*schema.names) for name, schema in schemas.OPERATIONAL.items()}
    tables["employees"] = intake.with_audit_times(tables["employees"])
    publish(tables, root)
    return root


def append_findings(spark, sf):
    """All reviews against the earlier state: taken ids, unknown employees and projects."""
    return appends.append_findings(spark, _early_store(spark, sf), "reviews", mapping.reviews(spark, sf))


def append_rows(spark, sf):
    """The later reviews of people and projects that the earlier state knows, appended to its reviews in two steps."""
    root, early, now = _early_store(spark, sf), mapping.base_tables(spark, sf), mapping.reviews(spark, sf)
    rows = (now.where("review_date >= date'2000-01-01'").join(early["employees"], "employee_id", "left_semi")
            .join(early["projects"], "project_id", "left_semi"))
    for part in (rows.where("rating < 3"), rows.where("rating >= 3")):
        load = appends.append_rows(spark, root, "reviews", part)
    return read_pieces(spark, root, load.of("reviews"), schemas.REVIEWS)


def _change_stream(spark, sf) -> scd2.ScdResult:
    """All department changes in four micro-batches, by date; the log put over the tables."""
    return changes.changed_tables(spark, stores.once(spark, sf, "changes", lambda: _streamed_changes(spark, sf)))


def _streamed_changes(spark, sf) -> str:
    w, root, source = stores.warehouse(spark, sf), io.work_path(spark, "changes"), io.work_path(spark, "changes-in")
    publish({"dim_employee": w.dim_employee, "employees": mapping.employees(spark, sf).drop("department_name")}, root)
    rows = mapping.department_changes(spark, sf)
    span = rows.agg(F.min("effective_date").alias("low"), F.datediff(F.max("effective_date"), F.min("effective_date")).alias("days")).first()
    part = F.floor(F.datediff("effective_date", F.lit(span.low)) * 4 / (span.days + 1))
    checkpoint = io.work_path(spark, "checkpoint")
    for k in range(4):  # what arrived since the last run is one micro-batch, however many files it has
        rows.where(part == k).write.mode("append").parquet(source)
        stream = streams.file_stream(spark, source, rows.schema)
        changes.department_change_stream(stream, root, w.dim_department, checkpoint, fold_after=2).awaitTermination()
    return root


def change_stream(spark, sf):
    """Keys are left out: they are given in order of the micro-batches."""
    return _change_stream(spark, sf).dim_employee.drop("employee_sk")


def change_stream_rejects(spark, sf):
    return _change_stream(spark, sf).rejects


QUERIES = [
    src_csv_roundtrip, csv_reordered, staging_load, oltp_load, load_summary, null_normalise,
    dim_department, dim_project, dim_date_full, dim_employee_full, review_dates_distinct,
    fact_full, fact_unmatched, scd2_point_in_time, version_at_start, multi_version_employees,
    employee_directory, employee_lookup, employee_exists, department_list, project_list,
    kpis, yearly_trend, top_employees, top_employees_by_sk, project_bottlenecks,
    project_bottlenecks_people, project_bottlenecks_by_id, department_performance,
    attrition_risk, attrition_distribution, attrition_top15, scalar_functions,
    upsert_department, upsert_project, insert_ignore_dates, new_employees, fact_incremental,
    fact_load_reviews, refresh_summary, scd2_apply, scd2_apply_day_before, scd2_employees,
    scd2_rejects, validate_employees, validate_employees_write, dq_unique, dq_not_null,
    dq_referential, dq_operational, dq_star, dq_check, dq_scd2, intake_employees, intake_projects, intake_assignments,
    intake_reviews, synth_seed, synth_employees, synth_projects, synth_assignments, synth_reviews,
    synth_history, review_date_guardrail, intake_stream, intake_stream_projects, intake_stream_assignments,
    intake_stream_reviews, change_stream, change_stream_rejects, append_findings, append_rows, intake_employees_insensitive,
    published_facts, *KEPT,
]


def all_queries() -> dict[str, Query]:
    def wrap(query: Query) -> Query:
        return lambda spark, sf_dir: comparable(query(spark, sf_dir))
    return {q.__name__: wrap(q) for q in QUERIES}
