"""Event-outcome analytics expressed as Spark DataFrame operators."""
