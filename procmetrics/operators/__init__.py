"""DataFrame operators on datapoints and tables."""
