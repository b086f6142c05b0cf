"""Race analytics on Spark: results, passages, routes and their quality, as DataFrame queries."""
