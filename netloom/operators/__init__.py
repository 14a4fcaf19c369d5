"""Operators on property graphs and time series."""
