"""rasterflow: deferred image pipelines and tabular helpers, declared as Spark plans."""

__version__ = "0.1.0"
