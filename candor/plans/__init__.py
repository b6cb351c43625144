"""Compositions of operators: detection, reports and the query catalogue."""
