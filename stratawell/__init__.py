"""Stratawell: multi-assay measurement analytics and training-data preparation on Spark."""
