"""Operators for large training-data pipelines. Nothing else in wavelake imports this package."""
