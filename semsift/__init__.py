"""semsift: hybrid semantic search (prepare, index, search) as Spark DataFrame operators."""

__version__ = "0.1.0"

__all__ = ["__version__"]
