"""Batch analytics over terrain-hazard tables: geometry, rasters, drainage, exposure and dataset hygiene on Spark DataFrames."""
