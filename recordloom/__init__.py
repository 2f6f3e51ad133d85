"""recordloom: analytics over revisioned, source-bound evidence records on Spark."""
