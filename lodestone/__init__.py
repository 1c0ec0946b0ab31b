"""Schema-driven extraction from text columns on Spark."""
