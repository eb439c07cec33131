"""Operators over the graph models."""
