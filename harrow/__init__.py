"""Recruitment analytics and data processing on PySpark DataFrames."""
