"""careflow.sources."""
