"""sourcinglens: supplier discovery and ranking as Spark DataFrame jobs.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame.  Nothing is collected to the driver; sessions are never created
inside operators.  See README.md for the operator map.
"""

__all__ = ["session"]
