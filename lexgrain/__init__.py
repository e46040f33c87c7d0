"""lexgrain: deterministic lexical retrieval and its evaluation as Spark plans."""

__version__ = "0.1.0"
