"""Spark-native analytics for paired evaluation of structured model outputs."""
