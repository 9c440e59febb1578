"""Event streams folded into state."""
