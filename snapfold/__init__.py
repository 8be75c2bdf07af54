"""Folds device snapshots of a relational library with Spark, and prepares training data."""
