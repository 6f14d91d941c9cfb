"""A Spark-native engine for template trees, the forms filled into them, and what a corpus pipeline needs."""
