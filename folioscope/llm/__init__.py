"""Operators of a training-data pipeline; nothing else in folioscope imports this."""
