"""Query plans: registered (spark, sf_dir) -> DataFrame callables and their
DuckDB oracle SQL, composed from the operators over the driver tables."""
