"""siltstone: public-record analytics expressed as plain Spark DataFrame functions."""

__version__ = "0.1.0"
