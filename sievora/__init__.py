"""sievora: full-text relevance and text-corpus processing on PySpark."""

__version__ = "0.1.0"
