"""Source/label confounding analytics and training-data operators on Spark SQL."""

__version__ = "0.1.0"
