"""Query compilation and loops."""
