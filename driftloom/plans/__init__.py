"""Whole runs: discovery of a site, the page pipeline, and the queries over tables."""
