"""Analytics on Spark: readers, checked schemas, versioned tables with a change feed, stateful streams."""
