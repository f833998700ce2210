"""pothi: a PySpark-native engine for retrieval-augmented question-answering corpora."""

__version__ = "0.1.0"
