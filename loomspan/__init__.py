"""loomspan: query-dependent context pruning and its datasets, as Spark DataFrame plans."""
