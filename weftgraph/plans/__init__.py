"""Composite queries: indexing and the search modes."""
