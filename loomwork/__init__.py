"""A Spark-native engine for preparing, deduplicating, sampling, splitting and scoring conversational text."""
