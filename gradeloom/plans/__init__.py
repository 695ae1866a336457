"""The catalogue of named queries."""
