"""Analytics over mathematical-knowledge corpora, expressed as Spark DataFrame and SQL plans."""

__version__ = "0.1.0"
