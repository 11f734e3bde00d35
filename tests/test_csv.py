import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.plans.landing import read_files, write_files
from staffmart.schemas import FILES, REVIEWS
from staffmart.sources.tables import bad_csv_rows, read_csv, write_csv

TEXT = "id int, words string"
SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("words", T.StringType())])


def written(tmp_path, content, name="in.csv"):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_text_comes_back_as_it_was(spark, tmp_path):
    words = ["  a b  ", 'say "x", y', "two\nlines", "back\\slash\\", None, " ", "NaN", "\ttab", "é, ü", '"', "a\r\nb"]
    rows = spark.createDataFrame(list(enumerate(words)), TEXT)
    path = str(tmp_path / "out")
    write_csv(rows, path)
    assert sorted(read_csv(spark, path, SCHEMA).collect()) == sorted(rows.collect())


def test_empty_text_is_missing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(spark.createDataFrame([(1, "")], TEXT), path)
    assert read_csv(spark, path, SCHEMA).first().words is None


def test_columns_are_found_by_name(spark, tmp_path):
    path = written(tmp_path, "words,more,id\nx,1,7\n y ,2,NaN\n")
    assert sorted(read_csv(spark, path, SCHEMA).collect(), key=str) == [(7, "x"), (None, " y ")]
    with pytest.raises(ValueError, match="no column words"):
        read_csv(spark, written(tmp_path, "word,id\nx,1\n", "b.csv"), SCHEMA)


def test_rows_that_do_not_fit_stop_the_job_or_are_set_apart(spark, tmp_path):
    path = written(tmp_path, "id,words\n1,good\nx,bad\n2.5,worse\n,none\n 3 ,spaces\n")
    with pytest.raises(Exception, match="id is no int"):
        read_csv(spark, path, SCHEMA).collect()
    assert sorted(r.words for r in read_csv(spark, path, SCHEMA, bad="skip").collect()) == ["good", "none", "spaces"]
    assert sorted((r.id, r.words, r.reason) for r in bad_csv_rows(spark, path, SCHEMA).collect()) == [
        ("2.5", "worse", "id is no int"), ("x", "bad", "id is no int")]


def test_reviews_with_turned_columns_are_not_mixed_up(spark, tmp_path):
    path = written(tmp_path, "review_id,project_id,employee_id,review_date,rating,review_score,comments\n"
                             'R1,P1,E1,2024-02-01,4,80.50,"one\ntwo"\nR2,P2,E2,NaT,nan,,\n')
    rows = sorted(read_csv(spark, path, REVIEWS).collect())
    assert tuple(rows[0]) == ("R1", "E1", "P1", dt.date(2024, 2, 1), 4, Decimal("80.50"), "one\ntwo")
    assert tuple(rows[1]) == ("R2", "E2", "P2", None, None, None, None)


def test_rows_can_be_counted(spark, tmp_path):
    text = T.StructType([T.StructField("words", T.StringType())])
    path = written(tmp_path, "id,words\n1,good\nx,bad\n")
    assert read_csv(spark, path, text).count() == 2 and bad_csv_rows(spark, path, text).count() == 0
    assert read_csv(spark, path, SCHEMA, bad="skip").count() == 1 and bad_csv_rows(spark, path, SCHEMA).count() == 1


def test_files_without_line_breaks_are_split(spark, make, tmp_path):
    """The writer notes which files have line breaks; the others are read by many tasks."""
    many = spark.range(40_000).select(F.format_string("A%d", "id").alias("assignment_id"), F.lit("E1").alias("employee_id"),
                                      F.lit("P1").alias("project_id"), F.lit("x").alias("assignment_role"),
                                      F.lit("2024-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    tables = {name: spark.createDataFrame([], schema) for name, schema in FILES.items()}
    tables |= {"assignments": many.coalesce(1), "reviews": make.reviews(dict(comments="two\nlines"), dict(comments="one"))}
    write_files(tables, str(tmp_path / "files"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        files = read_files(spark, str(tmp_path / "files"))
        assert files["assignments"].rdd.getNumPartitions() > 4
        assert files["assignments"].count() == 40_000
        assert sorted(r.comments for r in files["reviews"].collect()) == ["one", "two\nlines"]
        assert read_files(spark, str(tmp_path / "files"), multi_line=True)["assignments"].rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
