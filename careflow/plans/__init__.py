"""careflow.plans."""
