"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``candor.llm.registry`` holds the
queries and the SQL that ``__spark_entry__`` adds when the subpackage is there.
"""
