"""Input of the queries that is made by many tasks, whatever the sizes of the given tables."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from checks import mapping, queries


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nations_are_sent_to_the_customers(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(0, "EUROPE")], "r_regionkey long, r_name string").write.parquet(f"{folder}/region.parquet")
    spark.createDataFrame([(k, f"N{k}", 0) for k in range(25)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(
        f"{folder}/nation.parquet")
    spark.createDataFrame([(k, f"Customer#{k}", k % 25, -1.0, "AUTO") for k in range(50)],
                          "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(
        f"{folder}/customer.parquet")
    for rows in (mapping.employees(spark, folder), mapping.employee_history(spark, folder)):
        joins = [line for line in plan_of(rows).splitlines() if "BroadcastHashJoin" in line]
        assert "BuildRight" in joins[0]
        assert rows.count() == 50


def test_changes_of_a_micro_batch_come_in_many_files(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 4000, 1, 8).select(
        F.col("id").alias("change_id"), F.lit("E1").alias("employee_id"), F.lit(1).alias("new_department_id"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("effective_date"))
    seen = []

    def stream(changes, root, departments, checkpoint, **how):
        def count(batch, batch_id):
            span = batch.select("*", F.input_file_name().alias("file")).agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n"), F.min("effective_date").alias("low"), F.max("effective_date").alias("high")).first()
            seen.append((batch_id, span.files, span.n, str(span.low), str(span.high)))
        return (changes.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    people = spark.createDataFrame([("E1", "x")], "employee_id string, department_name string")
    monkeypatch.setattr(queries.stores, "warehouse", lambda spark, sf: SimpleNamespace(dim_employee=people, dim_department=people))
    monkeypatch.setattr(queries.mapping, "employees", lambda spark, sf: people)
    monkeypatch.setattr(queries.mapping, "department_changes", lambda spark, sf: rows)
    monkeypatch.setattr(queries.changes, "department_change_stream", stream)
    queries._streamed_changes(spark, "")
    assert [(k, n, low, high) for k, _, n, low, high in seen] == [
        (0, 1000, "2000-01-01", "2000-04-09"), (1, 1000, "2000-04-10", "2000-07-18"),
        (2, 1000, "2000-07-19", "2000-10-26"), (3, 1000, "2000-10-27", "2001-02-03")]
    assert all(files > 1 for _, files, *_ in seen)
