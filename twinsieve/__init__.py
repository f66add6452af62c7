"""Duplicate and near-duplicate detection as PySpark DataFrame operators."""
