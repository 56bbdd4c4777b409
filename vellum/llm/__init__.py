"""Operators for large training-data work on messy text records."""
