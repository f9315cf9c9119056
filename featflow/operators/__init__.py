"""Operators: fit/transform stages, statistics, sampling, models, ensembles, metrics."""
