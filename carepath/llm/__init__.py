"""Operators for building language-model training data from large text tables.

Nothing outside this folder imports it; `registry` lists its queries.
"""
