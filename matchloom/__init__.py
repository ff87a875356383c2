"""Cohorts, matched sets, look-back features and matched-set models as Spark jobs."""
