"""Functions of the news-edition engine."""
