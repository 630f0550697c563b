"""larkspur: strict, durable SQL tables on Spark.

A thin front end (parser, exact-name and strict-type analyzer, snapshot catalog)
turns six SQL statements into lazy DataFrames; Catalyst does everything after that.
"""

from larkspur.engine import Engine

__all__ = ["Engine"]
