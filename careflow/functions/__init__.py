"""careflow.functions."""
