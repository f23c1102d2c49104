"""Cross-checks."""
