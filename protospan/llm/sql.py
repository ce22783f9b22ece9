"""DuckDB SQL of the queries here that SQL can state."""

SQL: dict[str, str] = {}
