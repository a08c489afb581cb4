"""Operators of a training-data pipeline; nothing else in marketlake imports them."""
