"""Reading documents and keeping knowledge models."""
