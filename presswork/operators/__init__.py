"""Operators of the news-edition engine."""
