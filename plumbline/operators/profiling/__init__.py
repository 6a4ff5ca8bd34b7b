"""Dataset profiling as distributed aggregations."""
