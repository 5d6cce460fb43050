"""Spark-native news-edition analytics: sources, expressions, operators, plans and streams."""
