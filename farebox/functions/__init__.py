"""farebox functions."""
