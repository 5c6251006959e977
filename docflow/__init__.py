"""docflow: a PySpark-native engine for document-transcription data."""

__version__ = "0.1.0"
