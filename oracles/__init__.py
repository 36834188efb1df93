"""Independent DuckDB SQL for the driver's correctness gate."""
