"""Operators for training-data pipelines; ``queries()`` and ``sql()`` are in ``registry``."""
