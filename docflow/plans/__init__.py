"""docflow.plans."""
