"""docflow.sources."""
