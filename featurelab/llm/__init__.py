"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
