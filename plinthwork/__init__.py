"""plinthwork: entity intelligence on PySpark (DataFrame and SQL first)."""
