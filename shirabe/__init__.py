"""A Spark-native engine that finds Japanese personal data in text at scale."""
