"""End-to-end plans composed from operators."""
