"""Registered queries and the SQL each one is checked against."""

from feedloom.catalog import data, experiment, ranking, recall, samples, scans, serving, vectors

_MODULES = (data, recall, ranking, experiment, serving, vectors, scans, samples)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
