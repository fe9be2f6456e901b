"""loomlog: log condensation and log queries as Spark DataFrame operators."""
