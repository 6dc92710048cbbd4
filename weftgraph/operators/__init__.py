"""DataFrame operators on the tables of the knowledge model."""
