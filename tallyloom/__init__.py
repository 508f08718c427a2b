"""tallyloom: survey tabulation as fused Spark aggregations."""

__version__ = "0.1.0"
