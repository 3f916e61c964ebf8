"""farebox operators."""
