"""Labelled-corpus analytics on Spark DataFrames.

Canonical column names used by every operator:

``doc_id`` (unique, ordered), ``author``, ``label``, ``text``, ``tokens``, ``fold``.
"""
