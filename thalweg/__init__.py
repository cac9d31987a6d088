"""Raster hydrology on Spark."""
