"""Streaming of the news-edition engine."""
