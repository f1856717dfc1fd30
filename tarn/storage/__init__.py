"""Versioned tables."""
