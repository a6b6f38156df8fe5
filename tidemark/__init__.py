"""Change-data-capture and analytics on Spark."""
