"""evidra: Spark operators over rows of timed evidence, and over training text in ``evidra.llm``."""
