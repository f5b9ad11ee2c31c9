"""Study-deck analytics on Spark."""
