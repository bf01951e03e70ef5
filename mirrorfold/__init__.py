"""Change-data-capture mirrors, reporting projections and read models on Spark."""
