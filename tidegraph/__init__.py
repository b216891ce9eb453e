"""Link-graph influence analytics as PySpark DataFrame operators."""
