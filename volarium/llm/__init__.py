"""Operators for training-data pipelines; nothing outside this folder imports it but the entry module."""
