"""Data quality and fair model evaluation as PySpark DataFrame operators."""
