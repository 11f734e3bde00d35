"""Workforce analytics on Spark: star schema, employee history, reports and audits."""
