"""docflow.operators."""
