"""Spark-native analytics over snapshots of source repositories, and operators for training data."""
