"""twinscan: near-duplicate analytics on Spark."""
