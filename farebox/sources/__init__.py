"""farebox sources."""
