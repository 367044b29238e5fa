"""Millrace: composable, tested analytics operators for PySpark."""
