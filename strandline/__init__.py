"""Spark engine for text-described time series: plans, execution, checks, scoring and reports."""
