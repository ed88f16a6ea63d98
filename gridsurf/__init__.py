"""Raster-grid and point-cloud analytics on PySpark."""
