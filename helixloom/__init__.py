"""helixloom: structural-variant cohort analytics as Spark DataFrame operators."""
