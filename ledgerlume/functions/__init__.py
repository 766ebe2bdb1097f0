"""Column functions and constants that operators share."""
