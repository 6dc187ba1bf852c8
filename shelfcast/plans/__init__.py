"""Jobs over the driver tables: each registered query pairs a Spark plan
with an independent DuckDB formulation of the same result (the oracle)."""
