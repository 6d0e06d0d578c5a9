"""A query engine for trees, graphs and tables on Spark."""
