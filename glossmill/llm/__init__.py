"""Operators for training-data pipelines over web-scale text.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
