"""Operators for language-model training data. Nothing else in docflow imports this subpackage."""
