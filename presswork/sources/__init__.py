"""Sources of the news-edition engine."""
