"""Operators of a training-data pipeline over document, page and vector tables.

Nothing outside this subpackage imports it: ``__spark_entry__.py`` adds the
queries of :mod:`strataforge.llm.queries` when the subpackage is present.
"""
