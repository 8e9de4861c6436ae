"""Registered queries: each with the Spark plan and, where SQL can say it, its oracle."""
