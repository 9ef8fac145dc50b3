"""Registered queries (Spark callables with their DuckDB SQL) and the prepared table."""
