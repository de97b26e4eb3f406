"""Spark-native analytics for behavioural event streams and detector evaluation."""
