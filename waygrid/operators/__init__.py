"""DataFrame operators: spatial joins, ordered scans, rasters, aggregates and search."""
