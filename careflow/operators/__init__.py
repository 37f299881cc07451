"""careflow.operators."""
