"""Property adverts as Spark tables: enrichment, geography, market statistics and ranked search."""
