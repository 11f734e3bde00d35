"""Fixed values and random draws of the SQL side, written out again so that it shares none with the package."""

from __future__ import annotations

import hashlib

# Accepted forms of submitted text.
NAME = r"[A-Za-z][A-Za-z\s'-]*"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# department_id, name, location, budget, typical score.
DEPARTMENTS = [
    (1, "Engineering", "Bengaluru", 25000000, 84), (2, "Finance", "Mumbai", 12000000, 76),
    (3, "Human Resources", "Pune", 9000000, 79), (4, "Sales", "Delhi", 18000000, 68),
    (5, "Marketing", "Hyderabad", 11000000, 81), (6, "Operations", "Chennai", 15000000, 73)]

# Role, effect on the score in tenths of a point.
ROLES = [
    ("Software Engineer", 20), ("Senior Software Engineer", 40), ("Data Analyst", 10), ("Data Scientist", 50),
    ("HR Specialist", 0), ("Financial Analyst", 5), ("Sales Executive", -20), ("Project Manager", 30),
    ("Marketing Specialist", 10), ("Operations Analyst", -10), ("Product Manager", 25), ("Business Analyst", 10)]

# Project name, share of assignments in percent.
PROJECTS = [
    ("Customer Analytics Platform", 8), ("HR Modernization", 14), ("Cloud Migration", 22), ("Sales Intelligence", 10),
    ("Data Quality Program", 6), ("Employee Experience", 8), ("Finance Automation", 7), ("AI Recommendation Engine", 15),
    ("Mobile Platform", 4), ("Enterprise Reporting", 6)]

# Review year, effect on the score in points; choices with repetition standing for weights.
REVIEW_YEARS = {2024: -3, 2025: 0, 2026: 2}
PROJECT_STATUS = ["Planned", "Active", "Active", "Completed"]
GENDERS = ["Male", "Female"]
LEAVER_STATUS = ["Active", "Resigned"]

# Names of generated people.
FIRST_NAMES = ["Aarav", "Aditi", "Arjun", "Diya", "Farhan", "Ishaan", "Kavya", "Meera", "Nikhil", "Priya", "Rahul", "Riya",
               "Rohan", "Sana", "Tara", "Vikram"]
LAST_NAMES = ["Bose", "Das", "Gupta", "Iyer", "Joshi", "Kapoor", "Khan", "Mehta", "Nair", "Patel", "Rao", "Reddy", "Sen",
              "Shah", "Singh", "Verma"]

MERSENNE = 2**31 - 1


def draw_sql(purpose: str) -> str:
    """A draw mixes the two words of a row with three numbers from the first 21 digits of the md5 of its purpose."""
    digits = hashlib.md5(purpose.encode()).hexdigest()
    first, second, third = (int(digits[7 * k:7 * k + 7], 16) for k in range(3))
    return f"(({first} * w0 + {second} * w1 + {third}) % {MERSENNE})"


def between_sql(purpose: str, low: int, high: int) -> str:
    return f"({draw_sql(purpose)} % {high + 1 - low} + {low})"


def normal_sql(purpose: str, spread: int) -> str:
    """Twelve draws added up, scaled to a standard deviation, less their mean of six."""
    draws = " + ".join(draw_sql(f"{purpose}-{k}") for k in range(12))
    return f"({spread} * ({draws}) // {MERSENNE} - 6 * {spread})"
