"""Clause and entity-graph analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
starts a session or triggers a job unless its docstring says so.
"""
