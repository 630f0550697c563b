"""Expression functions: lowering of analyzed expressions to Spark columns."""
