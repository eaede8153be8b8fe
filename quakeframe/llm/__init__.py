"""Operators of a training-data pipeline: ten DataFrame operators over documents, pages and vectors.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""
