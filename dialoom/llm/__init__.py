"""Operators for large-scale training-data pipelines. Nothing else in dialoom imports this subpackage."""
