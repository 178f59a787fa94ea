"""Part of the quarry engine."""
