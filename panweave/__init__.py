"""Pan-genome graph analytics on Spark."""
