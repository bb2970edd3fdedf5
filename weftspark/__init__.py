"""Tensor, graph and trace analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
