"""Document retrieval analytics as lazy Spark plans."""
