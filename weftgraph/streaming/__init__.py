"""Continuous additions to a knowledge model."""
