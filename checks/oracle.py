"""The same results in DuckDB SQL over the given tables."""

from __future__ import annotations

import re

from checks.constants import (
    DEPARTMENTS, EMAIL, FIRST_NAMES, GENDERS, LAST_NAMES, LEAVER_STATUS, NAME, PROJECT_STATUS, PROJECTS, REVIEW_YEARS, ROLES,
    between_sql, draw_sql, normal_sql)

AS_OF = "DATE '2002-01-01'"

HIRE = "(DATE '1994-01-01' + CAST(37 * c_custkey % 1095 AS INT))"
SALARY = "CAST(240000 + (CAST(c_acctbal AS DECIMAL(15,2)) + 1000) * 30 AS DECIMAL(15,2))"
EMP = "printf('E%06d', c_custkey + 1)"


def project_of(index: str) -> str:
    return f"printf('P%04d', (({index}) + ({index}) // 7) % 10 + 1)"


# --- mapped tables --------------------------------------------------------------------

CTES = {
    "departments": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS department_id, n_name AS department_name, r_name AS location,
               CAST(1000000 * (n_nationkey + 1) AS DECIMAL(15,2)) AS budget
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "employees": f"""
        SELECT {EMP} AS employee_id, split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name, lower({EMP}) || '@example.com' AS email,
               CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
               21 + c_custkey % 45 AS age, CAST(c_nationkey + 1 AS BIGINT) AS department_id, c_mktsegment AS role,
               {SALARY} AS salary, {HIRE} AS hire_date,
               CASE WHEN c_acctbal > 9400 THEN 'Resigned' ELSE 'Active' END AS status
        FROM customer""",
    "projects": """
        SELECT printf('P%04d', s_suppkey + 1) AS project_id, 'Program ' || (s_suppkey % 5) AS project_name,
               s_name AS description, DATE '1994-01-01' + CAST(s_suppkey % 50 * 45 AS INT) AS start_date,
               DATE '1994-01-01' + CAST(s_suppkey % 50 * 45 + 360 AS INT) AS end_date,
               CASE s_suppkey % 4 WHEN 0 THEN 'Planned' WHEN 3 THEN 'Completed' ELSE 'Active' END AS status
        FROM supplier""",
    "assignments": f"""
        SELECT printf('A%07d', c_custkey + 1) AS assignment_id, {EMP} AS employee_id,
               {project_of('c_custkey * c_custkey')} AS project_id, c_mktsegment AS assignment_role,
               {HIRE} AS start_date, CAST(NULL AS DATE) AS end_date
        FROM customer
        UNION ALL
        SELECT printf('B%07d', c_custkey + 1), {EMP}, {project_of('c_custkey * c_custkey + 3')},
               'Cross-functional Member', {HIRE}, NULL
        FROM customer WHERE c_acctbal >= 6150""",
    "reviews": f"""
        SELECT printf('R%07d', o_orderkey + 1) AS review_id, printf('E%06d', o_custkey + 1) AS employee_id,
               {project_of('o_orderkey * o_orderkey')} AS project_id, CAST(o_orderdate AS DATE) AS review_date,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rating,
               CAST(floor(o_totalprice / 50) AS BIGINT) AS cents,
               (1995 + o_orderkey % 7) || ' performance review' AS comments
        FROM orders""",
    "history": f"""
        SELECT {EMP} AS employee_id, CAST((c_nationkey + 1) % 25 + 1 AS BIGINT) AS department_id, c_mktsegment AS role,
               CAST({SALARY} * 85 / 100 AS DECIMAL(15,2)) AS salary,
               {HIRE} + CAST(30 + c_custkey % 471 AS INT) AS start_date, DATE '1997-12-31' AS end_date
        FROM customer WHERE c_acctbal < 0""",
    "base_departments": """
        SELECT department_id, department_name || ' (old)' AS department_name, location,
               CAST(1 AS DECIMAL(15,2)) AS budget FROM departments""",
    "base_employees": "SELECT * FROM employees WHERE hire_date < DATE '1996-01-01'",
    "base_projects": """
        SELECT project_id, project_name, description, start_date, CAST(NULL AS DATE) AS end_date,
               'Planned' AS status FROM projects WHERE start_date >= DATE '1994-03-01'""",
    "base_reviews": """
        SELECT review_id, employee_id, project_id, review_date, CAST(3 AS BIGINT) AS rating, cents, comments
        FROM reviews WHERE review_date < DATE '2000-01-01'""",
    "base_history": """
        SELECT * FROM history WHERE employee_id IN (SELECT employee_id FROM base_employees)""",
    "changes": """
        SELECT event_id AS change_id, printf('E%06d', user_id + 1) AS employee_id,
               event_id % 27 + 1 AS new_department_id, CAST(ts AS DATE) AS effective_date FROM events""",
    "raw_versions": """
        SELECT event_id AS employee_sk, printf('E%06d', user_id + 1) AS employee_id,
               CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) + CAST(event_id % 7 - 1 AS INT) AS end_date,
               event_id % 9 = 0 AS is_current FROM events""",
    "submitted": """
        SELECT c_custkey AS submission_id,
               CASE c_custkey % 15 WHEN 1 THEN '' WHEN 3 THEN 'A1' ELSE ' Customer ' END AS first_name,
               CASE c_custkey % 15 WHEN 2 THEN '  ' WHEN 4 THEN 'B2' ELSE c_mktsegment END AS last_name,
               CASE c_custkey % 15 WHEN 5 THEN 'no-at'
                    ELSE 'e' || c_custkey || '@example.com' END AS email,
               CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
               CASE c_custkey % 15 WHEN 6 THEN 'abc' WHEN 7 THEN '17' WHEN 8 THEN '71'
                    ELSE CAST(21 + c_custkey % 45 AS VARCHAR) END AS age,
               CAST(CASE WHEN c_custkey % 7 = 3 THEN 999 ELSE c_nationkey + 1 END AS BIGINT) AS department_id,
               CASE c_custkey % 15 WHEN 9 THEN '' WHEN 10 THEN '12345' WHEN 11 THEN '---'
                    ELSE c_mktsegment END AS role,
               CASE c_custkey % 15 WHEN 12 THEN '0' WHEN 14 THEN 'abc' ELSE '500000' END AS salary,
               CASE c_custkey % 15 WHEN 13 THEN DATE '2100-01-01' ELSE DATE '2001-01-01' END AS hire_date
        FROM customer""",
    "submitted_projects": """
        SELECT s_suppkey AS submission_id,
               CASE WHEN s_nationkey = 3 THEN '  ' ELSE ' ' || s_name END AS project_name,
               ' plan ' AS description,
               CASE WHEN s_nationkey <> 4 THEN DATE '2001-01-01' END AS start_date,
               DATE '2001-07-01' AS end_date, 'Planned' AS status FROM supplier""",
    "submitted_assignments": f"""
        SELECT c_custkey AS submission_id,
               CASE c_nationkey WHEN 1 THEN ' ' WHEN 2 THEN 'X000001' ELSE ' ' || lower({EMP}) END AS employee_id,
               CASE WHEN c_nationkey = 5 THEN 'P99999' ELSE {project_of('c_custkey * c_custkey')} END AS project_id,
               CASE WHEN c_nationkey = 6 THEN '' ELSE ' Team Member ' END AS assignment_role,
               DATE '2001-01-01' AS start_date FROM customer""",
    "submitted_reviews": f"""
        SELECT o_orderkey AS submission_id,
               CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END || printf('E%06d', o_custkey + 1) AS employee_id,
               {project_of('o_orderkey * o_orderkey')} AS project_id, CAST(o_orderdate AS DATE) AS review_date,
               o_orderkey % 7 AS rating, CAST(floor(o_totalprice / 40) AS BIGINT) AS cents,
               ' ' || o_orderpriority || ' ' AS comments FROM orders""",
}


def star(prefix: str, source: str = "") -> dict[str, str]:
    """Star schema over departments, employees, projects, reviews and history."""
    return {
        f"{prefix}department": f"""
            SELECT row_number() OVER (ORDER BY department_id) AS department_sk, department_id,
                   department_name, location, budget FROM {source}departments""",
        f"{prefix}project": f"""
            SELECT row_number() OVER (ORDER BY project_id) AS project_sk, project_id, project_name,
                   status, start_date, end_date FROM {source}projects""",
        f"{prefix}date": f"""
            SELECT year(d) * 10000 + month(d) * 100 + day(d) AS date_sk, d AS full_date,
                   day(d) AS day_of_month, month(d) AS month_num, monthname(d) AS month_name,
                   quarter(d) AS quarter_num, year(d) AS year_num
            FROM (SELECT CAST(unnest(generate_series(min(review_date), max(review_date), INTERVAL 1 DAY)) AS DATE) AS d
                  FROM {source}reviews)""",
        f"{prefix}employee": f"""
            SELECT row_number() OVER (ORDER BY is_current, employee_id, start_date) AS employee_sk, v.*
            FROM (SELECT h.employee_id, first_name, last_name, email, gender, age, department_sk,
                         h.role, h.salary, hire_date, h.start_date, h.end_date, false AS is_current
                  FROM {source}history h JOIN {source}employees e ON e.employee_id = h.employee_id
                  JOIN {prefix}department d ON d.department_id = h.department_id
                  UNION ALL
                  SELECT e.employee_id, first_name, last_name, email, gender, age, department_sk, role,
                         salary, hire_date,
                         CASE WHEN e.employee_id IN (SELECT employee_id FROM {source}history)
                              THEN DATE '1998-01-01' ELSE hire_date END,
                         DATE '9999-12-31', true
                  FROM {source}employees e JOIN {prefix}department d ON d.department_id = e.department_id) v""",
        **fact_ctes(prefix, f"{source}reviews", f"{prefix}employee", f"{prefix}project", f"{prefix}date"),
        f"{prefix}fact": f"""
            SELECT row_number() OVER (ORDER BY date_sk, review_id) AS review_sk, * FROM {prefix}matched""",
    }


def fact_ctes(prefix: str, reviews: str, employee: str, project: str, date: str) -> dict[str, str]:
    return {
        f"{prefix}versioned": f"""
            SELECT r.review_id, e.employee_sk, e.department_sk,
                   row_number() OVER (PARTITION BY r.review_id
                                      ORDER BY e.start_date DESC, e.employee_sk DESC) AS rn
            FROM {reviews} r JOIN {employee} e ON e.employee_id = r.employee_id
             AND r.review_date BETWEEN e.start_date AND e.end_date""",
        f"{prefix}matched": f"""
            SELECT r.review_id, v.employee_sk, p.project_sk, v.department_sk, d.date_sk, r.rating, r.cents,
                   CAST(1 AS BIGINT) AS review_count, d.year_num
            FROM {reviews} r JOIN {prefix}versioned v ON v.review_id = r.review_id AND rn = 1
            JOIN {project} p ON p.project_id = r.project_id
            JOIN {date} d ON d.full_date = r.review_date""",
    }


CTES.update(star("dim_"))
CTES.update(star("base_dim_", "base_"))
CTES.update({
    "next_department": """
        SELECT b.department_sk, d.department_id, d.department_name, d.location, d.budget
        FROM departments d JOIN base_dim_department b USING (department_id)
        UNION ALL
        SELECT (SELECT max(department_sk) FROM base_dim_department)
               + row_number() OVER (ORDER BY department_id), * FROM departments
        WHERE department_id NOT IN (SELECT department_id FROM base_dim_department)""",
    "next_project": """
        SELECT b.project_sk, p.project_id, p.project_name, p.status, p.start_date, p.end_date
        FROM projects p JOIN base_dim_project b USING (project_id)
        UNION ALL
        SELECT (SELECT max(project_sk) FROM base_dim_project) + row_number() OVER (ORDER BY project_id),
               project_id, project_name, status, start_date, end_date FROM projects
        WHERE project_id NOT IN (SELECT project_id FROM base_dim_project)""",
    "added_dates": """
        SELECT DISTINCT year(review_date) * 10000 + month(review_date) * 100 + day(review_date) AS date_sk,
               review_date AS full_date, day(review_date) AS day_of_month, month(review_date) AS month_num,
               monthname(review_date) AS month_name, quarter(review_date) AS quarter_num,
               year(review_date) AS year_num
        FROM reviews WHERE review_date NOT IN (SELECT full_date FROM base_dim_date)""",
    "next_date": "SELECT * FROM base_dim_date UNION ALL SELECT * FROM added_dates",
    "added_versions": """
        SELECT (SELECT max(employee_sk) FROM base_dim_employee) + row_number() OVER (ORDER BY employee_id)
                 AS employee_sk,
               employee_id, first_name, last_name, email, gender, age, department_sk, role, salary, hire_date,
               hire_date AS start_date, DATE '9999-12-31' AS end_date, true AS is_current
        FROM employees JOIN base_dim_department USING (department_id)
        WHERE employee_id NOT IN (SELECT employee_id FROM base_dim_employee)""",
    "next_employee": "SELECT * FROM base_dim_employee UNION ALL SELECT * FROM added_versions",
    **fact_ctes("next_", "reviews", "next_employee", "next_project", "next_date"),
})


def merged_fact(name: str, matched: str) -> dict[str, str]:
    columns = ["employee_sk", "project_sk", "department_sk", "date_sk", "rating", "cents", "review_count",
               "year_num"]
    changed = " OR ".join(f"n.{c} <> f.{c}" for c in columns)
    return {name: f"""
        SELECT f.review_sk, f.review_id,
               {', '.join(f'coalesce(n.{c}, f.{c}) AS {c}' for c in columns)},
               CASE WHEN {changed} THEN 'updated' ELSE 'unchanged' END AS action
        FROM base_dim_fact f LEFT JOIN {matched} n ON n.review_id = f.review_id
        UNION ALL
        SELECT (SELECT max(review_sk) FROM base_dim_fact) + row_number() OVER (ORDER BY date_sk, review_id),
               review_id, {', '.join(columns)}, 'inserted'
        FROM {matched} WHERE review_id NOT IN (SELECT review_id FROM base_dim_fact)"""}


CTES.update(merged_fact("merged", "next_matched"))
CTES["low_reviews"] = "SELECT * FROM reviews WHERE rating = 1"
CTES.update(fact_ctes("low_", "low_reviews", "base_dim_employee", "base_dim_project", "base_dim_date"))
CTES.update(merged_fact("low_merged", "low_matched"))


def scd2_ctes(p: str, keep: str, close) -> dict[str, str]:
    """Chained changes; ``keep`` filters the valid ones, ``close`` ends a version."""
    return {
        f"{p}valid": f"""
            SELECT * FROM (
                SELECT c.*, d.department_sk AS target_sk, v.employee_sk AS old_sk, v.department_sk AS old_department,
                       lead(effective_date) OVER (PARTITION BY c.employee_id ORDER BY effective_date, change_id)
                         AS next_date
                FROM changes c JOIN dim_department d ON d.department_id = c.new_department_id
                JOIN dim_employee v ON v.employee_id = c.employee_id AND v.is_current)
            WHERE {keep}""",
        f"{p}moves": f"""
            SELECT * FROM (SELECT *, coalesce(lag(target_sk) OVER (PARTITION BY employee_id
                                              ORDER BY effective_date, change_id), old_department) AS before
                           FROM {p}valid) WHERE before <> target_sk""",
        f"{p}chain": f"""
            SELECT (SELECT max(employee_sk) FROM dim_employee)
                   + row_number() OVER (ORDER BY employee_id, effective_date, change_id) AS new_sk, *,
                   lead(effective_date) OVER (PARTITION BY employee_id ORDER BY effective_date, change_id) AS until
            FROM {p}moves""",
        f"{p}closing": f"SELECT old_sk, min(effective_date) AS closed_by FROM {p}moves GROUP BY old_sk",
        f"{p}result": f"""
            SELECT employee_sk, employee_id, first_name, last_name, email, gender, age, department_sk, role,
                   salary, hire_date, start_date, coalesce({close('closed_by')}, end_date) AS end_date,
                   is_current AND closed_by IS NULL AS is_current
            FROM dim_employee LEFT JOIN {p}closing ON old_sk = employee_sk
            UNION ALL
            SELECT new_sk, c.employee_id, first_name, last_name, email, gender, age, target_sk, role, salary,
                   hire_date, effective_date, coalesce({close('until')}, DATE '9999-12-31'), until IS NULL
            FROM {p}chain c JOIN employees e ON e.employee_id = c.employee_id""",
    }


CTES.update(scd2_ctes("same_", "true", lambda d: d))
CTES.update(scd2_ctes("before_", "next_date IS NULL OR next_date <> effective_date",
                      lambda d: f"CAST({d} - INTERVAL 1 DAY AS DATE)"))


# --- reports --------------------------------------------------------------------------

def mean6(total: str = "sum(cents)", n: str = "count(*)") -> str:
    """Mean in millionths, rounded half up, from whole cents."""
    return f"CAST((20000 * {total} + {n}) // (2 * {n}) AS BIGINT)"


def mean2(total: str = "sum(cents)", n: str = "count(*)") -> str:
    return f"CAST((2 * ({mean6(total, n)}) + 10000) // 20000 AS BIGINT) / 100.0"


CTES.update({
    "named_scores": f"""
        SELECT department_name, employee_id, first_name || ' ' || last_name AS employee_name, {mean6()} AS a6
        FROM dim_fact f JOIN dim_employee e ON e.employee_sk = f.employee_sk
        JOIN dim_department d ON d.department_sk = f.department_sk
        GROUP BY department_name, employee_id, first_name, last_name""",
    "keyed_scores": f"""
        SELECT e.department_sk, department_name, employee_id, first_name || ' ' || last_name AS employee_name,
               {mean6()} AS a6
        FROM dim_fact f JOIN dim_employee e ON e.employee_sk = f.employee_sk
        JOIN dim_department d ON d.department_sk = f.department_sk
        GROUP BY e.department_sk, department_name, employee_id, first_name, last_name""",
    "risk_means": f"SELECT employee_sk, {mean6()} AS a6 FROM dim_fact GROUP BY employee_sk",
    "risk_people": f"""
        SELECT employee_id, first_name || ' ' || last_name AS employee_name,
               datesub('year', hire_date, {AS_OF}) AS years_at_company, a6, salary
        FROM dim_employee e LEFT JOIN risk_means m ON m.employee_sk = e.employee_sk WHERE is_current""",
    "risk_scores": """
        SELECT *, (2 * (100000000 - coalesce(a6, 70000000)) * 60 + 1000000) // 2000000
                  + 100 * (CASE WHEN years_at_company BETWEEN 2 AND 5 THEN 10 WHEN years_at_company < 2 THEN 8
                                WHEN years_at_company BETWEEN 6 AND 10 THEN 5 ELSE 2 END)
                  + 100 * (CASE WHEN salary < 300000 THEN 15 WHEN salary < 400000 THEN 10
                                WHEN salary < 500000 THEN 5 ELSE 0 END) AS risk_cents
        FROM risk_people""",
    "risk": """
        SELECT employee_id, employee_name, CAST(years_at_company AS BIGINT) AS years_at_company,
               CAST((2 * a6 + 10000) // 20000 AS BIGINT) / 100.0 AS avg_score,
               CAST(salary AS DOUBLE) AS salary, CAST(risk_cents AS BIGINT) / 100.0 AS risk_score,
               CASE WHEN tile <= 4 THEN 'High' WHEN tile <= 15 THEN 'Medium' ELSE 'Low' END AS risk_level
        FROM (SELECT *, ntile(20) OVER (ORDER BY risk_cents DESC, employee_id) AS tile FROM risk_scores)""",
})

STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip(column: str) -> str:
    return STRIP.format(column)


def blank(column: str) -> str:
    return f"coalesce({strip(column)} = '', true)"


def form_rules(form: bool) -> str:
    name, email = NAME.replace("'", "''"), EMAIL
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    patterns = f"""
             WHEN NOT regexp_full_match({strip('first_name')}, '{name}') THEN 'first name not a name'
             WHEN NOT regexp_full_match({strip('last_name')}, '{name}') THEN 'last name not a name'
             WHEN NOT regexp_full_match({strip('email')}, '{email}') THEN 'email not valid'""" if form else f"""
             WHEN {blank('email')} THEN 'email required'"""
    letter = "[A-Za-z]" if form else r"\p{L}"
    return f"""
        CASE WHEN {blank('first_name')} THEN 'first name required'
             WHEN {blank('last_name')} THEN 'last name required'{patterns}
             WHEN NOT regexp_full_match({strip('age')}, '[+-]?\\d+') THEN 'age not an integer'
             WHEN CAST({strip('age')} AS HUGEINT) NOT BETWEEN 18 AND 70 THEN 'age out of range'
             WHEN {blank('role')} THEN 'role required'
             WHEN regexp_full_match({strip('role')}, '\\p{{Nd}}+') THEN 'role only digits'
             WHEN NOT regexp_matches({strip('role')}, '{letter}') THEN 'role without letters'
             WHEN NOT regexp_full_match({strip('salary')}, '{number}') THEN 'salary not a number'
             WHEN CAST({strip('salary')} AS DOUBLE) <= 0 THEN 'salary not positive'
             WHEN hire_date IS NULL THEN 'hire date required'
             WHEN hire_date > {AS_OF} THEN 'hire date in the future' END"""


def hashed(prefix: str, digits: int, value: str) -> str:
    return f"'{prefix}' || upper(substr(md5('{prefix}|' || {value}), 1, {digits}))"


CTES["judged"] = f"SELECT *, {form_rules(True)} AS reject_reason FROM submitted"


# --- generator ------------------------------------------------------------------------

def words(key: str) -> str:
    return ", ".join(f"CAST('0x' || substr(md5('42|' || {key}), {1 + 8 * i}, 8) AS BIGINT) AS w{i}" for i in range(2))


def pick(purpose: str, values: list[str]) -> str:
    options = ", ".join(f"'{v}'" for v in values)
    return f"([{options}])[{draw_sql(purpose)} % {len(values)} + 1]"


def weighted(purpose: str) -> str:
    arms, limit = [], 0
    for place, (_, share) in enumerate(PROJECTS):
        limit += share
        arms.append(f"WHEN {draw_sql(purpose)} % 100 < {limit} THEN {place + 1}")
    return f"CASE {' '.join(arms)} END"


def choose(key: str, values: dict, default) -> str:
    arms = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items())
    return f"CASE {key} {arms} ELSE {default} END"


def day_between(low: str, high: str, purpose: str) -> str:
    return f"(({low}) + CAST({draw_sql(purpose)} % greatest(1, datediff('day', {low}, {high}) + 1) AS INT))"


DEPARTMENT_NAMES = [d[1] for d in DEPARTMENTS]
ROLE_NAMES = [r for r, _ in ROLES]
TYPICAL = {d[0]: d[4] * 10000 for d in DEPARTMENTS}
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def safe_number(text: str, default: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '{NUMBER}') THEN trunc(CAST({text} AS DOUBLE)) ELSE {default} END"


CTES.update({
    "seed": """
        SELECT CAST(c_custkey + 1001 AS VARCHAR) AS EmployeeNumber,
               CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(15 + c_custkey % 60 AS VARCHAR) END AS Age,
               CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
               (['Engineering', 'Finance', 'Human Resources', 'Sales', 'Marketing', 'Operations', 'Legal',
                 'Research'])[c_custkey % 8 + 1] AS Department,
               CASE c_custkey % 13 WHEN 0 THEN 'nan' WHEN 1 THEN 'Data Scientist' WHEN 2 THEN 'Sales Executive'
                    WHEN 3 THEN 'Product Manager' ELSE c_mktsegment END AS JobRole,
               CASE WHEN c_custkey % 17 = 0 THEN 'unknown'
                    ELSE CAST(CAST(floor(c_acctbal * 10 + 20000) AS BIGINT) AS VARCHAR) END AS MonthlyIncome,
               CASE WHEN c_custkey % 19 = 0 THEN '?' ELSE CAST(c_custkey % 41 AS VARCHAR) END AS YearsAtCompany,
               CAST(c_custkey % 5 + 1 AS VARCHAR) AS JobLevel,
               CAST(c_custkey % 3 + 2 AS VARCHAR) AS PerformanceRating,
               CASE WHEN c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS Attrition
        FROM customer""",
    "sized": "SELECT count(*) AS size, 3 * count(*) AS total FROM seed",
    "numbered": f"""
        SELECT i, total, s.*, {words('i')}
        FROM sized, unnest(range(3 * size)) AS t(i)
        JOIN (SELECT *, row_number() OVER (ORDER BY CAST(EmployeeNumber AS BIGINT)) AS place FROM seed) s
          ON place = i % size + 1""",
    "drawn": f"""
        SELECT i, w0, w1, printf('E%06d', i + 1) AS employee_id, i < greatest(1, total // 10) AS has_past, total,
               {pick('first name', FIRST_NAMES)} AS first_name, {pick('last name', LAST_NAMES)} AS last_name,
               coalesce(Gender, {pick('gender', GENDERS)}) AS gender,
               greatest(21, least(65, {safe_number('Age', between_sql('age', 22, 55))})) AS age,
               greatest(0, least(35, {safe_number('YearsAtCompany', between_sql('years', 0, 15))})) AS years,
               CASE WHEN Department IN ({', '.join(f"'{d}'" for d in DEPARTMENT_NAMES)}) THEN Department
                    ELSE {pick('department', DEPARTMENT_NAMES)} END AS department_name,
               CASE WHEN trim(JobRole) = '' OR JobRole = 'nan' THEN {pick('role', ROLE_NAMES)}
                    ELSE JobRole END AS role,
               CAST(1200 * ({safe_number('MonthlyIncome', between_sql('income', 30000, 180000))}) AS BIGINT) AS cents,
               CASE WHEN Attrition = 'Yes' THEN {pick('leaver', LEAVER_STATUS)} ELSE 'Active' END AS status
        FROM numbered""",
    "hired": f"""
        SELECT *, lower(employee_id) || '@example.com' AS email,
               CAST({choose('department_name', {d[1]: d[0] for d in DEPARTMENTS}, 1)} AS BIGINT) AS department_id,
               CASE WHEN cents < 24000000 THEN 1200 * {between_sql('pay', 30000, 180000)}
                    ELSE cents END AS salary_cents,
               least(greatest(1995, least(2025, 2026 - years - {between_sql('hire year', 0, 5)})),
                     CASE WHEN has_past THEN 2022 ELSE 2025 END) AS hire_year
        FROM drawn""",
    "dated": f"""
        SELECT *, {day_between('make_date(CAST(hire_year AS BIGINT), 1, 1)',
                               'make_date(CAST(greatest(hire_year, CASE WHEN has_past THEN 2023 ELSE 2025 END) AS BIGINT), 12, 31)',
                               'hire day')} AS hire_date,
               {weighted('project')} AS project,
               CASE WHEN {draw_sql('has second')} % 100 < 35 THEN {weighted('second project')} END AS second_project,
               {choose('role', {r: t * 1000 for r, t in ROLES}, 0)} AS role_effect
        FROM hired""",
    "people": f"""
        SELECT *, CASE WHEN has_past THEN least(
                   hire_date + CAST(greatest(30, least(500, {between_sql('past start', 30, 899)})) AS INT),
                   DATE '2024-06-01') END AS past_start,
               greatest(450000, least(950000, {choose('department_id', TYPICAL, 720000)} + role_effect
                                              + {normal_sql('base', 50000)})) AS base
        FROM dated""",
})


def year_reviews(year: int) -> str:
    department = "department_id % 6 + 1" if year == 2024 else "department_id"
    earliest = "past_start" if year == 2024 else "hire_date"
    low = f"least(greatest({earliest}, DATE '{year}-01-15'), DATE '{year}-12-15')"
    offset = {2024: "1", 2025: "greatest(1, total // 10) + 1", 2026: "greatest(1, total // 10) + total + 1"}[year]
    return f"""
        SELECT printf('R%07d', i + {offset}) AS review_id, employee_id,
               printf('P%04d', CASE WHEN second_project IS NOT NULL AND {draw_sql(f'on second {year}')} % 100 < 25
                                    THEN second_project ELSE project END) AS project_id,
               {day_between(low, f"DATE '{year}-12-15'", f'review day {year}')} AS review_date,
               greatest(35000000, least(99000000, 55 * base + 35 * {choose(department, TYPICAL, 720000)}
                   + 10 * role_effect + 100 * ({REVIEW_YEARS[year] * 10000} + {normal_sql(f'noise {year}', 70000)})))
                 AS score,
               '{year} performance review' AS comments
        FROM people WHERE {'has_past' if year == 2024 else f'year(hire_date) <= {year}'}"""


CTES["synth_reviews"] = " UNION ALL ".join(f"({year_reviews(y)})" for y in REVIEW_YEARS)
CTES["synth_assignments"] = """
    SELECT printf('A%07d', i + 1) AS assignment_id, employee_id, printf('P%04d', project) AS project_id,
           role AS assignment_role, hire_date AS start_date FROM people
    UNION ALL
    SELECT printf('A%07d', total + row_number() OVER (ORDER BY i)), employee_id, printf('P%04d', second_project),
           'Cross-functional Member', hire_date
    FROM people WHERE second_project IS NOT NULL"""


# --- queries --------------------------------------------------------------------------

MONEY = "CAST({0} AS DOUBLE) AS {0}"
DEPARTMENT = "department_id, department_name, location, CAST(budget AS DOUBLE) AS budget"
PROJECT = ("project_id, project_name, status, CAST(start_date AS VARCHAR) AS start_date, "
           "CAST(end_date AS VARCHAR) AS end_date")
EMPLOYEE = ("employee_id, first_name, last_name, email, gender, age, department_id, role, "
            "CAST(salary AS DOUBLE) AS salary, CAST(hire_date AS VARCHAR) AS hire_date, status")
DATE = ("date_sk, CAST(full_date AS VARCHAR) AS full_date, day_of_month, month_num, month_name, "
        "quarter_num, year_num")
VERSION = ("employee_sk, employee_id, first_name, last_name, email, gender, age, department_sk, role, "
           "CAST(salary AS DOUBLE) AS salary, CAST(hire_date AS VARCHAR) AS hire_date, "
           "CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, is_current")
FACT = ("review_sk, review_id, employee_sk, project_sk, department_sk, date_sk, rating, "
        "cents / 100.0 AS review_score, review_count, year_num")


def unmatched_sql() -> str:
    return """
        SELECT r.review_id, r.employee_id, r.project_id, CAST(r.review_date AS VARCHAR) AS review_date,
               CASE WHEN v.review_id IS NULL THEN 'no version' WHEN p.project_id IS NULL THEN 'no project'
                    ELSE 'no date' END AS reason
        FROM reviews r LEFT JOIN (SELECT * FROM dim_versioned WHERE rn = 1) v ON v.review_id = r.review_id
        LEFT JOIN dim_project p ON p.project_id = r.project_id
        LEFT JOIN dim_date d ON d.full_date = r.review_date
        WHERE v.review_id IS NULL OR p.project_id IS NULL OR d.date_sk IS NULL"""


def counts_sql(counts: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}" for name, source in counts.items())


def top_sql(scores: str, group: str) -> str:
    return f"""
        SELECT * EXCLUDE (a6), a6 / 1000000.0 AS avg_score
        FROM (SELECT *, dense_rank() OVER (PARTITION BY {group} ORDER BY a6 DESC) AS performance_rank
              FROM {scores}) WHERE performance_rank <= 3"""


def bottleneck_sql(counted: str, name: str) -> str:
    return f"""
        SELECT project_name, count(DISTINCT {counted}) AS {name}, count(*) AS review_count, {mean2()} AS avg_score
        FROM dim_fact f JOIN dim_project p ON p.project_sk = f.project_sk
        JOIN dim_employee e ON e.employee_sk = f.employee_sk GROUP BY project_name"""


NO_PROJECT = "CAST(NULL AS VARCHAR) AS project_id"
SCALAR_RAW = "CASE o_orderkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN ' 18.9 ' WHEN 2 THEN '-7' ELSE '1e3' END"
ORDER_DATE = "CAST(o_orderdate AS DATE)"

BODIES = {
    "src_csv_roundtrip": """
        SELECT review_id, employee_id, project_id, CAST(review_date AS VARCHAR) AS review_date, rating,
               cents / 100.0 AS review_score, '  "' || comments || '", ' || chr(10) || ' and\\ more ' AS comments FROM reviews""",
    "csv_reordered": """
        WITH numbered AS (SELECT *, CAST(substr(review_id, 2) AS BIGINT) AS n FROM reviews),
        reasons AS (SELECT *, CASE WHEN n % 11 = 1 THEN 'review_date is no date'
                                   WHEN n % 7 = 1 THEN 'review_score is no decimal(6,2)' END AS reason FROM numbered)
        SELECT review_id, CASE WHEN reason IS NULL THEN employee_id END AS employee_id,
               CASE WHEN reason IS NULL THEN project_id END AS project_id,
               CASE WHEN reason IS NULL AND n % 11 <> 0 THEN CAST(review_date AS VARCHAR) END AS review_date,
               CASE WHEN reason IS NULL AND n % 5 > 1 THEN rating END AS rating,
               CASE WHEN reason IS NULL AND n % 7 <> 0 THEN cents / 100.0 END AS review_score,
               CASE WHEN reason IS NULL THEN comments END AS comments, reason FROM reasons""",
    "staging_load": counts_sql({"departments": "departments", "employees": "employees", "projects": "projects",
                                "assignments": "assignments", "reviews": "reviews",
                                "employee_history": "history"}),
    "oltp_load": f"SELECT {EMPLOYEE} FROM employees",
    "load_summary": counts_sql({
        "departments": "dim_department", "projects": "dim_project", "dates": "dim_date",
        "historical_versions": "dim_employee WHERE NOT is_current",
        "current_versions": "dim_employee WHERE is_current", "reviews": "reviews", "facts": "dim_fact"}),
    "null_normalise": """
        SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount,
               CASE WHEN o_orderkey % 5 > 2 THEN o_orderpriority END AS label FROM orders""",
    "dim_department": f"SELECT department_sk, {DEPARTMENT} FROM dim_department",
    "dim_project": f"SELECT project_sk, {PROJECT} FROM dim_project",
    "dim_date_full": f"SELECT {DATE} FROM dim_date",
    "dim_employee_full": f"SELECT {VERSION} FROM dim_employee",
    "review_dates_distinct": "SELECT DISTINCT CAST(review_date AS VARCHAR) AS review_date FROM reviews",
    "fact_full": f"SELECT {FACT} FROM dim_fact",
    "fact_unmatched": unmatched_sql(),
    "scd2_point_in_time": f"""
        SELECT {VERSION} FROM dim_employee WHERE DATE '1997-06-30' BETWEEN dim_employee.start_date
          AND dim_employee.end_date""",
    "multi_version_employees": """
        SELECT employee_id, count(*) AS versions FROM dim_employee GROUP BY employee_id HAVING count(*) > 1""",
    "employee_directory": """
        SELECT employee_id, first_name || ' ' || last_name AS employee_name, department_name, role,
               CAST(salary AS DOUBLE) AS salary, status
        FROM employees JOIN departments USING (department_id) ORDER BY employee_id LIMIT 100""",
    "employee_lookup": f"SELECT {EMPLOYEE} FROM employees WHERE employee_id = 'E000042'",
    "employee_exists": """
        SELECT DISTINCT employee_id, employee_id IN (SELECT employee_id FROM base_employees) AS employee_exists
        FROM assignments""",
    "department_list": "SELECT department_id, department_name FROM departments ORDER BY department_name",
    "project_list": f"SELECT {PROJECT} FROM projects ORDER BY project_name, project_id",
    "kpis": f"""
        SELECT (SELECT count(DISTINCT employee_id) FROM dim_employee WHERE is_current) AS employees,
               count(*) AS reviews, {mean2()} AS avg_score, CAST(sum(cents) AS BIGINT) / 100.0 AS total_score
        FROM dim_fact""",
    "yearly_trend": f"SELECT year_num AS year, {mean2()} AS avg_score FROM dim_fact GROUP BY year_num ORDER BY 1",
    "top_employees": top_sql("named_scores", "department_name"),
    "top_employees_by_sk": top_sql("keyed_scores", "department_sk"),
    "project_bottlenecks": bottleneck_sql("f.employee_sk", "employee_count"),
    "project_bottlenecks_people": bottleneck_sql("e.employee_id", "employee_count"),
    "project_bottlenecks_by_id": f"""
        SELECT project_id, project_name, count(DISTINCT employee_sk) AS employees_reviewed,
               count(*) AS review_count, {mean2()} AS avg_score
        FROM dim_fact f JOIN dim_project p ON p.project_sk = f.project_sk GROUP BY project_id, project_name""",
    "department_performance": f"""
        SELECT department_name, count(*) AS review_count, {mean2()} AS avg_score
        FROM dim_fact f JOIN dim_department d ON d.department_sk = f.department_sk GROUP BY department_name""",
    "version_at_start": """
        SELECT a.employee_sk, CAST(a.start_date AS VARCHAR) AS start_date,
               max_by(b.employee_sk, (b.start_date - DATE '1990-01-01') * 1000000000 + b.employee_sk) AS valid_sk
        FROM raw_versions a JOIN raw_versions b ON a.employee_id = b.employee_id
             AND a.start_date BETWEEN b.start_date AND b.end_date GROUP BY a.employee_sk, a.start_date""",
    "attrition_risk": "SELECT * FROM risk",
    "attrition_distribution": """
        SELECT risk_level, count(employee_id) AS employee_count
        FROM (VALUES ('High'), ('Medium'), ('Low')) AS l(risk_level) LEFT JOIN risk USING (risk_level)
        GROUP BY risk_level""",
    "attrition_top15": "SELECT * FROM risk ORDER BY risk_score DESC, employee_name, employee_id LIMIT 15",
    "scalar_functions": f"""
        SELECT o_orderkey AS row_id,
               year({ORDER_DATE}) * 10000 + month({ORDER_DATE}) * 100 + day({ORDER_DATE}) AS date_key,
               monthname({ORDER_DATE}) AS month_name, quarter({ORDER_DATE}) AS quarter_num,
               datesub('year', {ORDER_DATE}, {AS_OF}) AS years,
               CAST({ORDER_DATE} + 45 AS VARCHAR) AS later, datediff('day', {ORDER_DATE}, {AS_OF}) AS days,
               ((2 * CAST(round(o_totalprice * 100) AS BIGINT) + 3) // 6) / 100.0 AS third,
               round_even(o_custkey / 2.0, 0) AS half_even,
               greatest(100, least(900, o_orderkey)) AS clipped, o_orderkey % 6 + 1 AS rotated,
               printf('R%07d', o_orderkey + 1) AS padded, trim(o_orderpriority) AS stripped,
               upper(o_orderpriority) AS upper,
               CAST(trunc(coalesce(TRY_CAST(trim({SCALAR_RAW}) AS DOUBLE), -1)) AS BIGINT) AS as_int,
               coalesce(TRY_CAST(trim({SCALAR_RAW}) AS DOUBLE), -1) AS as_float,
               regexp_full_match(o_orderpriority, '[0-9]-[A-Z ]+') AS is_priority,
               regexp_matches(o_orderpriority, '\\p{{L}}') AS has_letter,
               {hashed('R', 12, 'o_orderkey')} AS hashed
        FROM orders""",
    "upsert_department": f"SELECT department_sk, {DEPARTMENT} FROM next_department",
    "upsert_project": f"SELECT project_sk, {PROJECT} FROM next_project",
    "insert_ignore_dates": f"SELECT {DATE} FROM next_date",
    "new_employees": f"SELECT {VERSION} FROM next_employee",
    "fact_incremental": f"SELECT {FACT}, action FROM merged",
    "fact_load_reviews": f"SELECT {FACT}, action FROM low_merged",
    "refresh_summary": counts_sql({
        "departments_synced": "departments", "projects_synced": "projects", "dates_added": "added_dates",
        "new_employees": "added_versions", "reviews_inserted": "merged WHERE action = 'inserted'",
        "reviews_updated": "merged WHERE action = 'updated'",
        "reviews_unchanged": "merged WHERE action = 'unchanged'"}),
    "scd2_apply": f"SELECT {VERSION} FROM same_result",
    "scd2_apply_day_before": f"SELECT {VERSION} FROM before_result",
    "scd2_employees": f"""
        SELECT {EMPLOYEE}, changed FROM (
            SELECT e.* REPLACE (coalesce(c.new_department_id, e.department_id) AS department_id),
                   c.employee_id IS NOT NULL AS changed
            FROM employees e LEFT JOIN same_chain c ON c.employee_id = e.employee_id AND c.until IS NULL)""",
    "scd2_rejects": """
        SELECT change_id, employee_id, new_department_id, CAST(effective_date AS VARCHAR) AS effective_date,
               'unknown department' AS reject_reason
        FROM changes WHERE new_department_id NOT IN (SELECT department_id FROM dim_department)""",
    "validate_employees": """
        SELECT submission_id, first_name, last_name, email, gender, age, department_id, role, salary,
               CAST(hire_date AS VARCHAR) AS hire_date, reject_reason FROM judged""",
    "validate_employees_write": f"""
        SELECT submission_id, first_name, last_name, email, gender, age, department_id, role, salary,
               CAST(hire_date AS VARCHAR) AS hire_date, reject_reason
        FROM (SELECT *, {form_rules(False)} AS reject_reason FROM submitted)""",
    "dq_unique": """
        SELECT employee_id, CAST(effective_date AS VARCHAR) AS effective_date, count(*) AS row_count
        FROM changes GROUP BY employee_id, effective_date HAVING count(*) > 1""",
    "dq_not_null": " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, count(*) FILTER ({missing}) AS missing, count(*) FILTER (false) AS too_long "
        "FROM submitted" for column, missing in {
            "first_name": "trim(first_name) = ''", "last_name": "trim(last_name) = ''", "email": "trim(email) = ''",
            "gender": "false", "age": "false", "department_id": "department_id IS NULL",
            "role": "trim(role) = ''", "salary": "trim(salary) = ''", "hire_date": "hire_date IS NULL"}.items()),
    "dq_referential": """
        SELECT employee_id, count(*) AS row_count FROM reviews
        WHERE employee_id NOT IN (SELECT employee_id FROM base_employees) GROUP BY employee_id""",
    "dq_check": """
        SELECT submission_id, employee_id, project_id, CAST(review_date AS VARCHAR) AS review_date, rating,
               cents / 100.0 AS review_score, comments FROM submitted_reviews WHERE rating NOT BETWEEN 1 AND 5""",
    "dq_scd2": """
        WITH chained AS (SELECT *, lead(start_date) OVER (PARTITION BY employee_id
                                   ORDER BY start_date, employee_sk) AS next_start FROM raw_versions),
        counted AS (SELECT employee_id, count(*) FILTER (is_current) AS current,
                           count(*) FILTER (start_date > end_date) AS backward,
                           count(*) FILTER (next_start < end_date) AS overlap FROM chained GROUP BY employee_id)
        SELECT employee_id, 'current versions' AS rule, current AS row_count FROM counted WHERE current <> 1
        UNION ALL SELECT employee_id, 'start after end', backward FROM counted WHERE backward > 0
        UNION ALL SELECT employee_id, 'overlap', overlap FROM counted WHERE overlap > 0""",
    "intake_employees": f"""
        SELECT CASE WHEN reject_reason IS NULL THEN 'E-' || submission_id
                    ELSE CAST(submission_id AS VARCHAR) END AS employee_id,
               CASE WHEN reject_reason IS NULL THEN {strip('first_name')} END AS first_name,
               CASE WHEN reject_reason IS NULL THEN {strip('last_name')} END AS last_name,
               CASE WHEN reject_reason IS NULL THEN {strip('email')} END AS email,
               CASE WHEN reject_reason IS NULL THEN gender END AS gender,
               CASE WHEN reject_reason IS NULL THEN CAST(age AS BIGINT) END AS age,
               CASE WHEN reject_reason IS NULL THEN department_id END AS department_id,
               CASE WHEN reject_reason IS NULL THEN {strip('role')} END AS role,
               CASE WHEN reject_reason IS NULL THEN CAST(salary AS DOUBLE) END AS salary,
               CASE WHEN reject_reason IS NULL THEN CAST(hire_date AS VARCHAR) END AS hire_date,
               CASE WHEN reject_reason IS NULL THEN 'Active' END AS status, reject_reason
        FROM (SELECT * REPLACE (CASE WHEN reject_reason IS NOT NULL THEN reject_reason
                                     WHEN department_id NOT IN (SELECT department_id FROM departments) THEN 'unknown department'
                                     WHEN submission_id % 4 = 0 THEN 'already taken in' END AS reject_reason)
              FROM judged)""",
    "intake_projects": f"""
        SELECT CASE WHEN r IS NULL THEN 'P-' || submission_id
                    ELSE CAST(submission_id AS VARCHAR) END AS project_id,
               CASE WHEN r IS NULL THEN trim(project_name) END AS project_name,
               CASE WHEN r IS NULL THEN trim(description) END AS description,
               CASE WHEN r IS NULL THEN CAST(start_date AS VARCHAR) END AS start_date,
               CASE WHEN r IS NULL THEN CAST(end_date AS VARCHAR) END AS end_date,
               CASE WHEN r IS NULL THEN status END AS status, r AS reject_reason
        FROM (SELECT *, CASE WHEN {blank('project_name')} THEN 'project name required'
                             WHEN start_date IS NULL THEN 'start date required'
                             WHEN submission_id % 4 = 0 THEN 'already taken in' END AS r FROM submitted_projects)""",
    "intake_assignments": f"""
        SELECT CASE WHEN r IS NULL THEN 'A-' || submission_id
                    ELSE CAST(submission_id AS VARCHAR) END AS assignment_id,
               CASE WHEN r IS NULL THEN upper(trim(employee_id)) END AS employee_id,
               CASE WHEN r IS NULL THEN project_id END AS project_id,
               CASE WHEN r IS NULL THEN trim(assignment_role) END AS assignment_role,
               CASE WHEN r IS NULL THEN CAST(start_date AS VARCHAR) END AS start_date,
               CAST(NULL AS VARCHAR) AS end_date, r AS reject_reason
        FROM (SELECT *, CASE WHEN {blank('employee_id')} THEN 'employee id required'
                             WHEN {blank('assignment_role')} THEN 'assignment role required'
                             WHEN upper(trim(employee_id)) NOT IN (SELECT employee_id FROM employees)
                               THEN 'unknown employee'
                             WHEN project_id NOT IN (SELECT project_id FROM projects) THEN 'unknown project'
                             WHEN submission_id % 4 = 0 THEN 'already taken in'
                        END AS r FROM submitted_assignments)""",
    "intake_reviews": f"""
        SELECT CASE WHEN r IS NULL THEN 'R-' || submission_id
                    ELSE CAST(submission_id AS VARCHAR) END AS review_id,
               CASE WHEN r IS NULL THEN upper(trim(employee_id)) END AS employee_id,
               CASE WHEN r IS NULL THEN project_id END AS project_id,
               CASE WHEN r IS NULL THEN CAST(review_date AS VARCHAR) END AS review_date,
               CASE WHEN r IS NULL THEN rating END AS rating,
               CASE WHEN r IS NULL THEN cents / 100.0 END AS review_score,
               CASE WHEN r IS NULL THEN trim(comments) END AS comments, r AS reject_reason
        FROM (SELECT *, CASE WHEN {blank('employee_id')} THEN 'employee id required'
                             WHEN upper(trim(employee_id)) NOT IN (SELECT employee_id FROM employees)
                               THEN 'unknown employee'
                             WHEN project_id NOT IN (SELECT project_id FROM projects) THEN 'unknown project'
                             WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating out of range'
                             WHEN cents NOT BETWEEN 0 AND 10000 THEN 'score out of range'
                             WHEN submission_id % 4 = 0 THEN 'already taken in'
                        END AS r FROM submitted_reviews)""",
    "synth_seed": "SELECT * FROM seed",
    "synth_employees": """
        SELECT employee_id, first_name, last_name, email, gender, CAST(age AS BIGINT) AS age, department_id,
               department_name, role, salary_cents / 100.0 AS salary, CAST(hire_date AS VARCHAR) AS hire_date, status
        FROM people""",
    "synth_projects": f"""
        SELECT printf('P%04d', i + 1) AS project_id, project_name,
               'Enterprise initiative: ' || project_name AS description,
               CAST(DATE '2024-01-01' + CAST(45 * i AS INT) AS VARCHAR) AS start_date,
               CAST(DATE '2024-01-01' + CAST(45 * i + {between_sql('length', 180, 540)} AS INT) AS VARCHAR)
                 AS end_date, {pick('status', PROJECT_STATUS)} AS status,
               (SELECT nullif(count(*), 0) FROM synth_assignments a
                WHERE a.project_id = printf('P%04d', p.i + 1)) AS assigned
        FROM (SELECT *, {words("'project' || i")} FROM (VALUES {', '.join(
            f"({i}, '{name}')" for i, (name, _) in enumerate(PROJECTS))}) AS v(i, project_name)) p""",
    "synth_assignments": """
        SELECT assignment_id, employee_id, project_id, assignment_role,
               CAST(start_date AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date FROM synth_assignments""",
    "synth_reviews": """
        SELECT review_id, employee_id, project_id, CAST(review_date AS VARCHAR) AS review_date,
               CAST(greatest(1, least(5, round_even(score / 20000000.0, 0))) AS BIGINT) AS rating,
               ((score + 5000) // 10000) / 100.0 AS review_score, comments FROM synth_reviews""",
    "synth_history": f"""
        SELECT employee_id, department_id % 6 + 1 AS department_id,
               {choose('department_id % 6 + 1', {d[0]: d[1] for d in DEPARTMENTS}, 'NULL')} AS department_name,
               {pick('past role', ROLE_NAMES)} AS role,
               ((2 * salary_cents * {between_sql('pay share', 7800, 9200)} + 10000) // 20000) / 100.0 AS salary,
               CAST(past_start AS VARCHAR) AS start_date, '2024-12-31' AS end_date, false AS is_current
        FROM people WHERE has_past""",
    "review_date_guardrail": f"""
        SELECT review_id, CAST(CASE WHEN year(review_date) <> y THEN make_date(y, 1, 15)
                   + CAST({between_sql('guardrail', 0, 333)} AS INT) ELSE review_date END AS VARCHAR)
                 AS review_date, comments
        FROM (SELECT *, CAST(substr(comments, 1, 4) AS BIGINT) AS y, {words('review_id')} FROM reviews)""",
}
# In the streams nothing was taken in before, and some submissions come once more without their id.
CTES["judged_stream"] = ("SELECT * FROM judged UNION ALL "
                         "SELECT * REPLACE (NULL AS submission_id) FROM judged WHERE department_id = 5")
for _kind, _source, _nameless in (("employees", "judged", ""), ("projects", "submitted_projects", "start_date IS NULL"),
                                  ("assignments", "submitted_assignments", "project_id = 'P0005'"),
                                  ("reviews", "submitted_reviews", "rating = 6")):
    if _nameless:
        CTES[f"{_source}_stream"] = (f"SELECT * FROM {_source} UNION ALL "
                                     f"SELECT * REPLACE (NULL AS submission_id) FROM {_source} WHERE {_nameless}")
    BODIES["intake_stream" if _kind == "employees" else f"intake_stream_{_kind}"] = (
        BODIES[f"intake_{_kind}"].replace("WHEN submission_id % 4 = 0 THEN 'already taken in'",
                                          "WHEN submission_id IS NULL THEN 'submission id required'")
        .replace(f"FROM {_source})", f"FROM {_source}_stream)"))
CTES["judged_shouted"] = """
    SELECT * REPLACE (CASE WHEN reject_reason IS NULL AND (submission_id >= 1000000000 OR submission_id % 4 = 1)
                           AND department_id IN (SELECT department_id FROM departments)
                           THEN 'email already used' ELSE reject_reason END AS reject_reason)
    FROM (SELECT * FROM judged UNION ALL
          SELECT * REPLACE (submission_id + 1000000000 AS submission_id, upper(email) AS email) FROM judged WHERE department_id BETWEEN 1 AND 9)"""
BODIES["intake_employees_insensitive"] = (
    BODIES["intake_employees"].replace("WHEN submission_id % 4 = 0 THEN 'already taken in' ", "").replace("FROM judged)", "FROM judged_shouted)"))
BODIES["append_findings"] = """
    SELECT 'reviews.review_id taken' AS rule, review_id AS key, count(*) AS row_count FROM reviews
    WHERE review_id IN (SELECT review_id FROM base_reviews) GROUP BY review_id
    UNION ALL
    SELECT 'reviews.employee_id not in employees', employee_id, count(*) FROM reviews
    WHERE employee_id NOT IN (SELECT employee_id FROM base_employees) GROUP BY employee_id
    UNION ALL
    SELECT 'reviews.project_id not in projects', project_id, count(*) FROM reviews
    WHERE project_id NOT IN (SELECT project_id FROM base_projects) GROUP BY project_id"""
BODIES["append_rows"] = """
    SELECT review_id, employee_id, project_id, CAST(review_date AS VARCHAR) AS review_date, rating, cents / 100.0 AS review_score, comments
    FROM (SELECT * FROM base_reviews UNION ALL
          SELECT * FROM reviews WHERE review_date >= DATE '2000-01-01' AND employee_id IN (SELECT employee_id FROM base_employees)
            AND project_id IN (SELECT project_id FROM base_projects))"""
BODIES["change_stream"] = f"SELECT {VERSION.replace('employee_sk, ', '', 1)} FROM same_result"
BODIES["change_stream_rejects"] = BODIES["scd2_rejects"]


CTES["doubled_reviews"] = """SELECT review_id, employee_id, project_id FROM reviews
    UNION ALL SELECT review_id, employee_id, project_id FROM base_reviews"""


def findings(keys: str, references: str, tables: dict[str, str]) -> str:
    """Repeated keys and references to nothing; written as table.column and child.column>parent."""
    parts = []
    for key in keys.split():
        table, column = key.split(".")
        parts.append(f"SELECT '{key} repeated' AS rule, CAST({column} AS VARCHAR) AS key, count(*) AS row_count "
                     f"FROM {tables[table]} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1")
    for reference in references.split():
        child, column, parent = reference.replace(">", ".").split(".")
        parts.append(f"SELECT '{child}.{column} not in {parent}' AS rule, CAST({column} AS VARCHAR) AS key, count(*) AS row_count "
                     f"FROM {tables[child]} WHERE {column} IS NOT NULL AND {column} NOT IN "
                     f"(SELECT {column} FROM {tables[parent]}) GROUP BY {column}")
    return " UNION ALL ".join(parts)


BODIES["dq_operational"] = findings(
    "departments.department_id departments.department_name employees.employee_id employees.email projects.project_id "
    "assignments.assignment_id reviews.review_id",
    "employees.department_id>departments assignments.employee_id>employees assignments.project_id>projects "
    "reviews.employee_id>employees reviews.project_id>projects",
    {"departments": "departments", "employees": "base_employees", "projects": "base_projects",
     "assignments": "assignments", "reviews": "doubled_reviews"})
BODIES["dq_star"] = "SELECT rule, count(*) AS keys, CAST(sum(row_count) AS BIGINT) AS row_count FROM (" + findings(
    "dim_department.department_id dim_project.project_id dim_date.date_sk dim_date.full_date dim_employee.employee_sk "
    "fact.review_sk fact.review_id",
    "dim_employee.department_sk>dim_department fact.employee_sk>dim_employee fact.project_sk>dim_project "
    "fact.department_sk>dim_department fact.date_sk>dim_date",
    {"dim_department": "base_dim_department", "dim_project": "base_dim_project", "dim_date": "base_dim_date",
     "dim_employee": "base_dim_employee", "fact": "dim_fact"}) + ") GROUP BY rule"


def after_refresh(sql: str) -> str:
    """A report on the tables after a refresh of the earlier state."""
    for table, now in (("dim_fact", "merged"), ("dim_employee", "next_employee"), ("dim_department", "next_department"),
                       ("dim_project", "next_project"), ("dim_date", "next_date"), ("named_scores", "next_named_scores"),
                       ("keyed_scores", "next_keyed_scores")):
        sql = re.sub(rf"\b{table}\b", now, sql)
    return sql


for _name in ("named_scores", "keyed_scores"):
    CTES[f"next_{_name}"] = after_refresh(CTES[_name])
for _name in ("kpis", "yearly_trend", "top_employees", "top_employees_by_sk", "project_bottlenecks", "project_bottlenecks_by_id",
              "department_performance"):
    BODIES[f"kept_{_name}"] = after_refresh(BODIES[_name])
BODIES["published_facts"] = f"SELECT {FACT} FROM merged"


def all_sql() -> dict[str, str]:
    """Each query with the table expressions it needs, directly or through others."""
    names = list(CTES)
    uses = {name: set(re.findall(r"\w+", sql)) & set(names) - {name} for name, sql in CTES.items()}

    def needed(sql: str) -> list[str]:
        wanted, stack = set(), list(set(re.findall(r"\w+", sql)) & set(names))
        while stack:
            name = stack.pop()
            if name not in wanted:
                wanted.add(name)
                stack.extend(uses[name])
        return [name for name in names if name in wanted]

    out = {}
    for key, body in BODIES.items():
        ctes = ", ".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed(body))
        out[key] = f"WITH {ctes} SELECT * FROM ({body})" if ctes else body
    return out
