"""farebox streaming."""
