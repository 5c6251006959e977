"""docflow.functions."""
