"""Points, shares and fund allocation over partitioned tables, on Spark."""
