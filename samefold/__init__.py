"""samefold: product lookup, deduplication and corpus preparation as Spark plans."""
