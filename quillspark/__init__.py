"""quillspark: a Spark-native analytics engine for citation corpora."""

__version__ = "0.1.0"
