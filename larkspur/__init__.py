"""larkspur: a Spark-native engine for curating audio and speech corpora."""

__version__ = "0.1.0"
