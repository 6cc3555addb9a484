"""Registered queries, by domain, and the DuckDB SQL with the same rows."""
