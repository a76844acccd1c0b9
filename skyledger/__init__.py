"""Spark-native analytics over rasters, catalogs, dataset listings, event logs and evaluations."""
