"""A Spark-native analytics engine for listing-style data."""
