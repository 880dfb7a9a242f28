"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage: it may be removed whole
(with ``corpus_pipeline.py`` and ``tests/llm``) and the rest keeps working.
"""
