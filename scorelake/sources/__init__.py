"""Readers of patterns, molecules, examples, schemas, databases and cached results."""
