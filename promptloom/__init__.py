"""Semantic (model-in-SQL) analytics on Spark: prompts, inference and what surrounds
them as ordinary DataFrame operators."""
