import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from staffmart.schemas import DEPARTMENTS, DIM_EMPLOYEE, EMPLOYEES, REVIEWS  # noqa: E402
from staffmart.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text)


class Make:
    """Small frames with sensible defaults for the columns a test does not care about."""

    def __init__(self, spark):
        self.spark = spark

    def rows(self, schema, rows):
        nullable = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
        return self.spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], nullable)

    def departments(self, *names):
        return self.rows(DEPARTMENTS, [
            dict(department_id=i + 1, department_name=n, location="here", budget=Decimal(1000))
            for i, n in enumerate(names)])

    def employees(self, *rows):
        out = []
        for r in rows:
            e = dict(first_name="Ann", last_name=r["employee_id"], email=r["employee_id"] + "@example.com",
                     gender="Female", age=30, department_id=1, role="Analyst", salary=Decimal(450000),
                     hire_date="2024-01-01", status="Active")
            e.update(r)
            e["hire_date"] = day(e["hire_date"])
            out.append(e)
        return self.rows(EMPLOYEES, out)

    def versions(self, *rows):
        out = []
        for i, r in enumerate(rows):
            v = dict(employee_sk=i + 1, first_name="Ann", last_name=r["employee_id"], email=None, gender=None,
                     age=30, department_sk=1, role="Analyst", salary=Decimal(450000), hire_date="2024-01-01",
                     start_date="2024-01-01", end_date="9999-12-31", is_current=True)
            v.update(r)
            for c in ("hire_date", "start_date", "end_date"):
                v[c] = day(v[c])
            v["salary"] = Decimal(v["salary"])
            out.append(v)
        return self.rows(DIM_EMPLOYEE, out)

    def reviews(self, *rows):
        out = []
        for i, r in enumerate(rows):
            v = dict(review_id=f"R{i + 1}", employee_id="E1", project_id="P1", review_date="2024-06-01",
                     rating=3, review_score="80.00", comments=None)
            v.update(r)
            v["review_date"] = v["review_date"] and day(v["review_date"])
            v["review_score"] = Decimal(v["review_score"])
            out.append(v)
        return self.rows(REVIEWS, out)


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)
