"""Terralyn: field time-series and pixel-grid analytics on PySpark DataFrames."""
