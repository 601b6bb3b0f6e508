"""Compositions of operators and the helpers they share."""
