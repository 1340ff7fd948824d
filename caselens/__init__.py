"""Case-text analytics as PySpark DataFrame operators."""
