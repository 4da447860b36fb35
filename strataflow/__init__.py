"""Cohorts, features, preprocessing, evaluation and reporting as Spark jobs."""
