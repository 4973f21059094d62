"""Daily files as they arrive."""
