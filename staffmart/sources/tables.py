"""Readers and writers: CSV interchange files, Parquet tables, JDBC tables, work tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.session import shared_dir

T_ = TypeVar("T_")


# fixed values: spellings of a missing value
MISSING = ("", "nan", "NaN", "NaT")
_BAD = "_bad"


def _raw_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """All columns of the schema as text, found by their names in the header, and ``_bad``."""
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=False,
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    header = reader.option("inferSchema", False).csv(path).columns
    absent = [name for name in schema.names if name not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    given = T.StructType([T.StructField(name, T.StringType()) for name in header] + [T.StructField(_BAD, T.StringType())])
    rows = reader.schema(given).option("columnNameOfCorruptRecord", _BAD).csv(path)
    # Spark refuses a scan of the corrupt-record column alone, so a count needs a value column too.
    some = F.length(F.coalesce(F.col(schema.names[0]), F.lit(""))) >= 0
    return rows.select(*schema.names, F.when(F.col(_BAD).isNotNull() & some, "malformed row").alias(_BAD))


def _typed(column: str, kind: T.DataType) -> Column:
    """The value of a column; a spelling of a missing value is NULL, and so is what does not parse."""
    if isinstance(kind, T.StringType):
        return F.col(column)
    bare = F.trim(F.col(column))
    return F.when(~bare.isin(*MISSING), bare).try_cast(kind)


def _judged_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    rows, reason = _raw_csv(spark, path, schema, multi_line), F.col(_BAD)
    for field in schema:
        if not isinstance(field.dataType, T.StringType):
            wrong = _typed(field.name, field.dataType).isNull() & ~F.trim(F.col(field.name)).isin(*MISSING)
            reason = F.coalesce(reason, F.when(wrong, f"{field.name} is no {field.dataType.simpleString()}"))
    return rows.withColumn(_BAD, reason)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, bad: str = "fail", multi_line: bool = True) -> DataFrame:
    """CSV with a header, whose columns are found by name; other columns are left out.

    Missing values may be spelled in any way of ``MISSING`` where a number or date is due; text stays as it
    is, but for an empty one, which is missing. A row with a value that does not fit stops the job, or with ``bad="skip"`` is left out;
    ``bad_csv_rows`` returns it. Files without line breaks inside values may be read with ``multi_line=False``,
    which lets Spark split them.
    """
    rows = _judged_csv(spark, path, schema, multi_line)
    typed = [_typed(f.name, f.dataType).alias(f.name) for f in schema]
    if bad == "skip":
        return rows.where(F.col(_BAD).isNull()).select(*typed)
    stop = F.raise_error(F.concat(F.lit(f"{path}: "), F.col(_BAD)))
    return rows.where(F.when(F.col(_BAD).isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))).select(*typed)


def bad_csv_rows(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """The rows that ``read_csv`` skips, as text, with the first reason."""
    rows = _judged_csv(spark, path, schema, multi_line)
    return rows.where(F.col(_BAD).isNotNull()).select(*schema.names, F.col(_BAD).alias("reason"))


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header; text keeps its outer spaces, quotes and line breaks.

    Returns the number of rows with a line break in a value: without any, the file may be read with ``multi_line=False``.
    """
    texts = [F.col(f.name).rlike(r"[\r\n]") for f in df.schema if isinstance(f.dataType, T.StringType)]
    broken = F.lit(False)
    for text in texts:
        broken = broken | F.coalesce(text, F.lit(False))
    return written_counts(df, lambda rows: (
        rows.write.mode("overwrite")
        .options(header=True, dateFormat="yyyy-MM-dd", quote='"', escape='"',
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)), broken=F.count_if(broken))["broken"]


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Replace the table at ``path`` whole, whatever the session's overwrite mode is."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    columns = list(partition_by)
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, split_on: str, lower: int, upper: int,
              parts: int, **options: str) -> DataFrame:
    """Database table read in ``parts`` ranges of the numeric column ``split_on``."""
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=split_on, lowerBound=lower,
                     upperBound=upper, numPartitions=parts, **options)
            .load())


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 5000, **options: str) -> None:
    """Append to a database table in batches of ``batch`` rows per task."""
    (df.write.format("jdbc").mode("append")
     .options(url=url, dbtable=table, batchsize=batch, **options).save())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at this path; asks for the one path and lists nothing."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def require_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raise one error that names every missing input, before any job is planned."""
    missing = [path for path in paths if not exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def nulls_for_missing(df: DataFrame) -> DataFrame:
    """NaN in floating columns and empty or 'NaN'/'NaT' text become NULL."""
    out = []
    for field in df.schema:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        elif isinstance(field.dataType, T.StringType):
            col = F.when(~F.trim(col).isin(*MISSING), col)
        out.append(col.alias(field.name))
    return df.select(*out)


def together(spark: SparkSession, jobs: dict[str, Callable[[], T_]]) -> dict[str, T_]:
    """Run independent jobs side by side, so small ones do not wait for each other.

    The first error is raised after all have ended.
    """
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
    return {name: job.result() for name, job in running.items()}


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; never reused, so nothing read is ever overwritten.

    All paths of an application are in one folder, which can go when the application ended.
    """
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written_counts(df: DataFrame, write: Callable[[DataFrame], object], **counts: Column) -> dict[str, int]:
    """Write ``df`` by ``write`` and return what was counted on the rows as they went by.

    ``df`` should not be the input of a range partitioning in the same job, whose sampling would see rows twice.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return {name: int(n or 0) for name, n in seen.get.items()}


def clear_work(spark: SparkSession) -> None:
    """Remove all work tables of this application; frames that read them are of no use afterwards."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, so a lost executor cannot bring back a different row order or
    partition number, and later passes read only the columns they need.
    """
    return materialise_counted(df, label)[0]


def materialise_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """As ``materialise``, with counts taken while the rows were written."""
    spark = df.sparkSession
    path = work_path(spark, label)
    if counts:
        found = written_counts(df, lambda rows: rows.write.parquet(path), **counts)
    else:
        df.write.parquet(path)
        found = {}
    return spark.read.schema(df.schema).parquet(path), found
