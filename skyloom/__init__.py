"""Spectral sample-table analytics as composable Spark DataFrame operators."""
