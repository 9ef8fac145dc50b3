"""Operators: DataFrame in, DataFrame out; the core work runs as Spark jobs."""
