"""Audit, pruning and routing over prompt x model evaluation matrices, on Spark."""

__version__ = "0.1.0"
