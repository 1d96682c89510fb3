"""Operators of the time-series model on wide frames."""
