"""Execution of analyzed statements: queries stay lazy DataFrames, changes are copy-on-write."""
