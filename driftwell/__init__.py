"""driftwell: incrementally maintained grouped views and data-processing operators on PySpark."""

__version__ = "0.1.0"
