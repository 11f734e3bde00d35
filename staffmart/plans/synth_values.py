"""Fixed values of the test data generator."""

# department_id, name, location, budget, typical score.
DEPARTMENTS = [
    (1, "Engineering", "Bengaluru", 25000000, 84),
    (2, "Finance", "Mumbai", 12000000, 76),
    (3, "Human Resources", "Pune", 9000000, 79),
    (4, "Sales", "Delhi", 18000000, 68),
    (5, "Marketing", "Hyderabad", 11000000, 81),
    (6, "Operations", "Chennai", 15000000, 73),
]

# Role, effect on the score in tenths of a point.
ROLES = [
    ("Software Engineer", 20),
    ("Senior Software Engineer", 40),
    ("Data Analyst", 10),
    ("Data Scientist", 50),
    ("HR Specialist", 0),
    ("Financial Analyst", 5),
    ("Sales Executive", -20),
    ("Project Manager", 30),
    ("Marketing Specialist", 10),
    ("Operations Analyst", -10),
    ("Product Manager", 25),
    ("Business Analyst", 10),
]

# Project name, share of assignments in percent.
PROJECTS = [
    ("Customer Analytics Platform", 8),
    ("HR Modernization", 14),
    ("Cloud Migration", 22),
    ("Sales Intelligence", 10),
    ("Data Quality Program", 6),
    ("Employee Experience", 8),
    ("Finance Automation", 7),
    ("AI Recommendation Engine", 15),
    ("Mobile Platform", 4),
    ("Enterprise Reporting", 6),
]

# Review year, effect on the score in points.
REVIEW_YEARS = {2024: -3, 2025: 0, 2026: 2}

# Choices with repetition standing for weights.
PROJECT_STATUS = ["Planned", "Active", "Active", "Completed"]
SEED_RATINGS = ["2", "3", "3", "3", "4"]
SEED_ATTRITION = ["Yes", "No", "No", "No", "No"]
GENDERS = ["Male", "Female"]
LEAVER_STATUS = ["Active", "Resigned"]

# Our own short name lists.
FIRST_NAMES = ["Aarav", "Aditi", "Arjun", "Diya", "Farhan", "Ishaan", "Kavya", "Meera", "Nikhil",
               "Priya", "Rahul", "Riya", "Rohan", "Sana", "Tara", "Vikram"]
LAST_NAMES = ["Bose", "Das", "Gupta", "Iyer", "Joshi", "Kapoor", "Khan", "Mehta", "Nair", "Patel",
              "Rao", "Reddy", "Sen", "Shah", "Singh", "Verma"]
