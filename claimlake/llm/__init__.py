"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it: ``__spark_entry__.py`` adds the
queries of :mod:`claimlake.llm.queries` when the subpackage is present.
"""
