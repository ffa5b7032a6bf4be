"""Token-graph analytics on Spark: records, the short tokens they share, and the groups these form."""
