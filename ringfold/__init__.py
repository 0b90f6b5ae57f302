"""Analytics over streams of call records on Spark: running aggregates, queries over them, rules."""
