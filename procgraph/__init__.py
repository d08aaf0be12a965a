"""Workflow-project analytics on Spark DataFrames."""
