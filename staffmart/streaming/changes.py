"""Department changes as a stream, kept as a log beside the tables they change.

A micro-batch looks up the employees it names in hash buckets that hold each one's row and current version. It appends the
versions it closed and opened, the employees it moved and the changes it refused as pieces of their own, and
brings the buckets it touched up to date; nothing else is read or written. Readers put the log over the tables. After
``fold_after`` micro-batches the log is folded into the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from staffmart.operators.merge import next_key
from staffmart.operators.scd2 import SAME_DAY, ScdResult, apply_department_changes
from staffmart.schemas import DIM_EMPLOYEE
from staffmart.sources.key_index import BUCKET_ROWS, KeyIndex
from staffmart.sources.key_index import TABLE as KEYS
from staffmart.sources.tables import materialise, together
from staffmart.sources.versions import Load, Piece, current_load, drop_entry, enter, new_folder, read_pieces, write_whole

VERSIONS_LOG, EMPLOYEES_LOG, REJECTS = "dim_employee_log", "employees_log", "rejects"
FOLD_AFTER = 50
KEPT_ENTRIES = 20
_REJECTS = T.StructType([T.StructField(name, kind) for name, kind in (
    ("change_id", T.LongType()), ("employee_id", T.StringType()), ("new_department_id", T.IntegerType()),
    ("effective_date", T.DateType()), ("reject_reason", T.StringType()))])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _with_seq(schema: T.StructType) -> T.StructType:
    return T.StructType([*_nullable(schema), T.StructField("seq", T.LongType())])


def _merged(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows of a table with the newest logged row in place of each that has one, and the logged ones it lacks."""
    newest = log.groupBy(key).agg(F.max_by(F.struct(*base.columns), "seq").alias("row")).select("row.*")
    return base.join(log.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(newest)


def changed_tables(spark: SparkSession, root: str, load: Load | None = None) -> ScdResult:
    """dim_employee, employees and refused changes as they are now, the log put over the tables."""
    load = load or current_load(spark, root)
    people = _people_schema(spark, root, load)
    versions = _merged(read_pieces(spark, root, load.of("dim_employee"), _nullable(DIM_EMPLOYEE)),
                       read_pieces(spark, root, load.of(VERSIONS_LOG), _with_seq(DIM_EMPLOYEE)), "employee_sk")
    employees = _merged(read_pieces(spark, root, load.of("employees"), people),
                        read_pieces(spark, root, load.of(EMPLOYEES_LOG), _with_seq(people)), "employee_id")
    return ScdResult(versions, employees, read_pieces(spark, root, load.of(REJECTS), _REJECTS))


def _people_schema(spark: SparkSession, root: str, load: Load) -> T.StructType:
    """Columns of the employees as they were published; with audit times or without."""
    path = load.of("employees")[0].path
    return _nullable(spark.read.parquet(path if path.startswith("/") or "://" in path else f"{root}/{path}").schema)


def _state(people: T.StructType) -> T.StructType:
    """What is kept for an employee: its row and its current version."""
    return T.StructType([T.StructField("person", people), T.StructField("version", _nullable(DIM_EMPLOYEE))])


def _states(dim_employee: DataFrame, employees: DataFrame) -> DataFrame:
    now = (dim_employee.where("is_current").groupBy("employee_id")
           .agg(F.max_by(F.struct(*DIM_EMPLOYEE.names), "employee_sk").alias("version")))
    person = employees.select("employee_id", F.struct(*employees.columns).alias("person"))
    return person.join(now, "employee_id", "left").select(F.col("employee_id").alias("key"), "person", "version")


def fold(spark: SparkSession, root: str) -> None:
    """Write the tables anew with their log in them. Keys and refused changes stay as they are."""
    load = current_load(spark, root)
    now = changed_tables(spark, root, load)
    folder = new_folder(root)
    written = together(spark, {
        "dim_employee": lambda: write_whole(now.dim_employee, root, folder, "dim_employee"),
        "employees": lambda: write_whole(now.employees, root, folder, "employees")})
    kept = load.without("dim_employee", "employees", VERSIONS_LOG, EMPLOYEES_LOG)
    enter(spark, root, folder, [*kept, *written["dim_employee"], *written["employees"]], load.notes, after=load.version)


def department_change_stream(changes: DataFrame, root: str, dim_department: DataFrame, checkpoint: str,
                             close_policy: str = SAME_DAY, fold_after: int = FOLD_AFTER,
                             bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Apply department changes per micro-batch to the tables published under ``root`` (dim_employee and employees).

    The first micro-batch reads the tables once to fill the buckets. One that was entered already is
    skipped. ``changed_tables`` gives the result.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        load = current_load(spark, root)
        if int(load.notes.get("batch", -1)) >= batch_id:
            return
        if len(load.of(VERSIONS_LOG)) >= fold_after:
            fold(spark, root)
            load = current_load(spark, root)
        people = _people_schema(spark, root, load)
        if "next_sk" not in load.notes:
            now = changed_tables(spark, root, load)
            pieces, notes = KeyIndex(spark, root, None, _state(people), bucket_rows).with_rows(
                materialise(_states(now.dim_employee, now.employees), "states"))
            load = Load(load.version, load.folder, [*load.without(KEYS), *pieces],
                        {**load.notes, **{k: str(v) for k, v in notes.items()}, "next_sk": str(next_key(now.dim_employee, "employee_sk"))})
        index = KeyIndex(spark, root, load, _state(people), bucket_rows)
        first_sk, seq = int(load.notes["next_sk"]), F.lit(load.version + 1).cast("long").alias("seq")
        # Written once: the changes are judged, ordered and reported from the same rows.
        batch = materialise(batch, "changes-in")
        state = materialise(index.find(batch.select(F.col("employee_id").alias("key"))), "state")
        result = apply_department_changes(
            state.where("version is not null").select("version.*"), batch, state.select("person.*"), dim_department,
            close_policy, first_sk)
        # The state holds current versions only, so a row that is not current now was closed.
        logged = materialise(result.dim_employee.where((F.col("employee_sk") >= first_sk) | ~F.col("is_current")), "logged")
        opened = logged.where((F.col("employee_sk") >= first_sk) & F.col("is_current"))
        moved = materialise(result.employees.join(opened.select("employee_id"), "employee_id", "left_semi").select(*people.names), "moved")
        folder = new_folder(root)

        def append(table: str, rows: DataFrame) -> list[Piece]:
            return load.of(table) + ([] if rows.isEmpty() else write_whole(rows, root, folder, table))

        def states() -> tuple[list[Piece], dict[str, int]]:
            return index.with_rows(materialise(_states(opened, moved), "states"), added=0)

        done = together(spark, {
            VERSIONS_LOG: lambda: append(VERSIONS_LOG, logged.select("*", seq)),
            EMPLOYEES_LOG: lambda: append(EMPLOYEES_LOG, moved.select("*", seq)),
            REJECTS: lambda: append(REJECTS, result.rejects.select(*_REJECTS.names)), KEYS: states})
        keys, notes = done.pop(KEYS)
        top = logged.agg(F.max("employee_sk").alias("top")).first().top
        notes = {**load.notes, **notes, "batch": batch_id, "next_sk": max(first_sk, (top or 0) + 1)}
        kept = load.without(KEYS, VERSIONS_LOG, EMPLOYEES_LOG, REJECTS)
        version = enter(spark, root, folder, [*kept, *keys, *[p for own in done.values() for p in own]], notes, after=load.version)
        drop_entry(spark, root, version - KEPT_ENTRIES)

    return (changes.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
